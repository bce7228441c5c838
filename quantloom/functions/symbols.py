"""Symbols by vendor, security identifiers, default benchmarks and the algorithm behind a metric's name, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix of each market's symbols by vendor.
SUFFIXES = {
    "yahoo": {
        "US": "", "NASDAQ": "", "NYSE": "", "AMEX": "", "OTC": "", "ETF": "", "UK": ".L", "LSE": ".L", "AIM": ".L", "EU": ".PA", "EURONEXT": ".PA", "EURONEXT_AMSTERDAM": ".AS",
        "EURONEXT_BRUSSELS": ".BR", "EURONEXT_LISBON": ".LS", "EURONEXT_PARIS": ".PA", "COPENHAGEN": ".CO", "EURONEXT_DUBLIN": ".IR", "HELSINKI": ".HE", "INDEX": "", "OSLO": ".OL",
        "XETRA": ".DE", "BME": ".MC", "BORSA_ITALIANA": ".MI", "SIX": ".SW", "STOCKHOLM": ".ST", "SSE": ".SS", "SZSE": ".SZ", "BJSE": ".BJ", "VIENNA": ".VI",
    },
    "bloomberg": {
        "US": " US Equity", "NASDAQ": " US Equity", "NYSE": " US Equity", "AMEX": " US Equity", "OTC": " US Equity", "ETF": " US Equity", "UK": " LN Equity", "LSE": " LN Equity",
        "AIM": " LN Equity", "EU": " EB Equity", "EURONEXT": " NA Equity", "EURONEXT_AMSTERDAM": " NA Equity", "EURONEXT_BRUSSELS": " BB Equity", "EURONEXT_LISBON": " PL Equity",
        "EURONEXT_PARIS": " FP Equity", "COPENHAGEN": " DC Equity", "EURONEXT_DUBLIN": " ID Equity", "HELSINKI": " FH Equity", "INDEX": " Index", "OSLO": " NO Equity",
        "XETRA": " GY Equity", "BME": " SM Equity", "BORSA_ITALIANA": " IM Equity", "SIX": " SW Equity", "STOCKHOLM": " SS Equity", "SSE": " CH Equity", "SZSE": " CH Equity",
        "BJSE": " CH Equity", "VIENNA": " AV Equity",
    },
}
# Market and currency of an exchange's code in a security identifier.
EXCHANGES = {
    "US": ("US", "USD"), "UA": ("US", "USD"), "UN": ("US", "USD"), "UQ": ("US", "USD"), "UW": ("US", "USD"), "LN": ("LSE", "GBP"), "GY": ("XETRA", "EUR"), "SM": ("BME", "EUR"),
    "IM": ("BORSA_ITALIANA", "EUR"), "SW": ("SIX", "CHF"), "FP": ("EURONEXT_PARIS", "EUR"), "NA": ("EURONEXT_AMSTERDAM", "EUR"), "BB": ("EURONEXT_BRUSSELS", "EUR"),
    "PL": ("EURONEXT_LISBON", "EUR"), "DC": ("COPENHAGEN", "DKK"), "FH": ("HELSINKI", "EUR"), "ID": ("EURONEXT_DUBLIN", "EUR"), "NO": ("OSLO", "NOK"), "SS": ("STOCKHOLM", "SEK"),
    "AV": ("VIENNA", "EUR"),
}
# Default benchmarks, and the instruments that benchmark labels stand for.
EUROPEAN = ("AIM", "BME", "BORSA_ITALIANA", "EU", "EURONEXT", "LSE", "SIX", "UK", "XETRA")
CHINESE = ("SSE", "SZSE", "BJSE")
BENCHMARKS = {"us": ("SPY", "QQQ"), "europe": ("SXXP", "SX5E"), "china": ("CSI300", "CSI500")}
BENCHMARK_ALIASES = {"SXXP": ("^STOXX", "INDEX"), "SX5E": ("^STOXX50E", "INDEX"), "STOXX600": ("^STOXX", "INDEX"), "STOXX50E": ("^STOXX50E", "INDEX"), "CSI300": ("000300", "SSE"), "CSI500": ("000905", "SSE")}
# Patterns of metric names and the algorithm each stands for; the first that fits counts.
ALGORITHMS = (
    ("price_return$", "full_history_return"),
    ("simple_moving_average", "simple_moving_average"),
    ("exponential_moving_average", "exponential_moving_average"),
    ("relative_strength_index", "wilder_rsi"),
    ("macd_signal", "macd_signal"),
    ("macd_histogram$", "macd_histogram"),
    ("macd", "macd"),
    ("bollinger", "bollinger_band"),
    ("average_true_range", "wilder_atr"),
    ("momentum", "momentum"),
    ("annualized_volatility", "annualized_volatility"),
    ("volume_trend", "volume_trend"),
    ("kdj_", "kdj_calculation"),
    ("adx_", "adx_calculation"),
    ("efficiency_ratio", "efficiency_ratio"),
    ("worth_buy_", "worth_buy_alpha_weighted"),
    ("markov_(current_regime|signal)", "markov_regime_detection"),
    ("markov_stationary_", "markov_stationary_distribution"),
    ("markov_persistence_", "markov_transition_matrix"),
    ("markov_walkforward_", "markov_walkforward"),
    ("(technical_basic|on_balance_volume|volume_ratio)_", "technical_basic_composite"),
    ("(downside_volatility|historical_c?var_95|return_skewness|return_excess_kurtosis|(best|worst)_daily_return|max_drawdown)$", "historical_risk_statistics"),
    ("(volatility_regime_|volatility_trend$)", "volatility_regime_percentile"),
)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def vendor_symbol(vendor: str, symbol: Column, market: Column) -> Column:
    """A vendor's name of an instrument; null for a market that the vendor doesn't serve. An unknown vendor is an error."""
    name = vendor.strip().lower()
    if name == "ccxt":
        return F.when(market == "CRYPTO", symbol)
    return F.concat(symbol, F.try_element_at(_map(SUFFIXES[name]), market))


def security(text: Column) -> Column:
    """Struct (security, symbol, market, currency) of an identifier as 'REP SM Equity', its symbol and exchange in any case and
    with blanks around; null for other texts and unknown exchanges. A slash in the symbol becomes a dash."""
    pattern = "^([A-Za-z0-9][A-Za-z0-9./=^-]{0,31}) ([A-Za-z]{2}) Equity$"
    t = F.trim(text)
    name, code = F.upper(F.regexp_extract(t, pattern, 1)), F.upper(F.regexp_extract(t, pattern, 2))
    market, currency = (F.try_element_at(_map({k: v[i] for k, v in EXCHANGES.items()}), code) for i in (0, 1))
    found = F.struct(F.concat(name, F.lit(" "), code, F.lit(" Equity")).alias("security"), F.translate(name, "/", "-").alias("symbol"), market.alias("market"), currency.alias("currency"))
    return F.when((name != "") & market.isNotNull(), found)


def benchmarks(market: Column, configured: tuple[str, ...] = ()) -> Column:
    """Benchmark labels: the configured ones in upper case, or those of the market's region if none or only AUTO is."""
    own = [c.strip().upper() for c in configured if c.strip()]
    array = lambda names: F.array(*map(F.lit, names))
    if own and own != ["AUTO"]:
        return array(own)
    return F.when(market.isin(*CHINESE), array(BENCHMARKS["china"])).when(market.isin(*EUROPEAN), array(BENCHMARKS["europe"])).otherwise(array(BENCHMARKS["us"]))


def benchmark_instrument(label: Column) -> Column:
    """Struct (symbol, market) of a label: an alias, a six-digit code by its first digit, a dotted symbol, or a US one."""
    name = F.upper(F.trim(label))
    first = F.substring(name, 1, 1)
    exchange = F.when(first.isin("5", "6", "9"), "SSE").when(first.isin("4", "8"), "BJSE").otherwise("SZSE")
    symbol, market = (F.try_element_at(_map({k: v[i] for k, v in BENCHMARK_ALIASES.items()}), name) for i in (0, 1))
    other = F.when(name.rlike("^[0-9]{6}$"), exchange).when(name.contains("."), "EU").otherwise("US")
    return F.struct(F.coalesce(symbol, name).alias("symbol"), F.coalesce(market, other).alias("market"))


def algorithm(metric: Column) -> Column:
    """The algorithm of a metric's name; null for an unknown one."""
    return F.coalesce(*[F.when(metric.rlike(f"^{pattern}"), F.lit(name)) for pattern, name in ALGORITHMS])


def configuration_reference(settings: dict) -> str:
    """sha256 reference of a configuration's JSON with sorted keys: equal settings give one reference, in any order."""
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str, allow_nan=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
