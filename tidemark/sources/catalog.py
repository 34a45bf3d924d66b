"""Catalogue of public series and the bundles they form; loaders read landed observations (code, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public codes of the series, by group and name.
SERIES = {
    "treasury": {"1M": "DGS1MO", "3M": "DGS3MO", "6M": "DGS6MO", "1Y": "DGS1", "2Y": "DGS2", "3Y": "DGS3", "5Y": "DGS5", "7Y": "DGS7", "10Y": "DGS10", "20Y": "DGS20", "30Y": "DGS30"},
    "yield_curve": {"10Y-2Y": "T10Y2Y"},
    "fed_funds": {"Fed_Funds": "FEDFUNDS"},
    "sofr_libor": {"SOFR": "SOFR", "LIBOR_3M": "USD3MTD156N"},
    "money_supply": {"M1": "M1SL", "M2": "M2SL"},
    "fed_balance_sheet": {"Fed_Balance_Sheet": "WALCL"},
    "repo_rates": {"SOFR": "SOFR", "ON_RRP_Rate": "RRPONTSYD"},
    "credit_spreads": {"IG_Spread": "BAMLC0A0CM", "HY_Spread": "BAMLH0A0HYM2"},
    "gdp": {"real": "GDPC1", "nominal": "GDP"},
    "inflation": {"CPI": "CPIAUCSL", "PCE": "PCEPI", "Core_CPI": "CPILFESL"},
    "employment": {"Unemployment_Rate": "UNRATE", "Nonfarm_Payrolls": "PAYEMS", "Initial_Claims": "ICSA"},
    "pmi": {"ISM_Manufacturing": "MANEMP", "ISM_NonManufacturing": "NMFBACTIVITYY"},
    "sentiment": {"Michigan_Sentiment": "UMCSENT"},
    "ecb_rates": {"Main_Refinancing_Rate": "ECBMRRFR", "Deposit_Facility_Rate": "ECBDFR"},
    "euribor": {"1M": "IR3TIB01EZM156N", "3M": "IR3TIB01EZM156N", "6M": "EURONTD156N", "12M": "EURONTD156N"},
    "euro_gdp": {"Euro_GDP": "CLVMNACSCAB1GQEA19"},
    "bonds_10y": {"Italy": "IRLTLT01ITM156N", "Germany": "IRLTLT01DEM156N"},
    "volatility": {"VIX": "^VIX", "SKEW": "^SKEW"},
    "sectors": {"Financials": "XLF", "Technology": "XLK", "Energy": "XLE", "Healthcare": "XLV", "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Industrials": "XLI", "Materials": "XLB", "Utilities": "XLU", "Real Estate": "XLRE", "Communication": "XLC"},
    "coins": {"BTC": "bitcoin", "ETH": "ethereum"},
    "fear_greed": {"Fear_Greed": "fear_greed"},
}
# Groups of each bundle.
BUNDLES = {
    "crypto_ecosystem": ("coins", "fear_greed"), "risk_indicators": ("volatility", "credit_spreads", "yield_curve"), "liquidity_monitor": ("money_supply", "fed_balance_sheet", "repo_rates"),
    "rates_dashboard": ("treasury", "sofr_libor", "credit_spreads"), "macro_us": ("gdp", "inflation", "employment", "sentiment"), "macro_europe": ("ecb_rates", "euribor", "euro_gdp"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """grp, name, code of every series."""
    return spark.createDataFrame([(g, n, c) for g, names in SERIES.items() for n, c in names.items()], "grp string, name string, code string")


def bundle_groups(name: str) -> tuple[str, ...]:
    """Groups of a bundle; ValueError listing the bundles if there is none of that name."""
    if name not in BUNDLES:
        raise ValueError(f"unknown bundle {name!r}; one of {', '.join(sorted(BUNDLES))}")
    return BUNDLES[name]


def load_groups(observations: DataFrame, groups: tuple[str, ...], start: str | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """grp, name, ts, value of the landed observations (code, ts, value) that belong to the groups; names unknown are ignored.

    NULL values are dropped; the start date is pushed down to the scan. A series in two groups comes out in both.
    """
    wanted = catalogue(observations.sparkSession).where(F.col("grp").isin(*groups))
    if names is not None:
        wanted = wanted.where(F.col("name").isin(*names))
    rows = observations.where("value is not null")
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("date"))
    return rows.join(F.broadcast(wanted), "code").select("grp", "name", "ts", "value")  # the catalogue is a constant


def load_bundle(observations: DataFrame, name: str, start: str | None = None) -> DataFrame:
    """The series of a bundle."""
    return load_groups(observations, bundle_groups(name), start)


def slope(observations: DataFrame, long_code: str = "DGS10", short_code: str = "DGS2", ready_code: str = "T10Y2Y") -> DataFrame:
    """ts, slope: the ready-made series where it has the day, else long minus short on the days both have."""
    rows = observations.where(F.col("value").isNotNull() & F.col("code").isin(long_code, short_code, ready_code))
    by_day = rows.groupBy("ts").agg(*[F.max(F.when(F.col("code") == c, F.col("value"))).alias(n) for n, c in (("a", long_code), ("b", short_code), ("r", ready_code))])
    return by_day.select("ts", F.coalesce("r", F.col("a") - F.col("b")).alias("slope")).where("slope is not null")
