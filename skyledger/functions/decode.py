"""Decoding of hourly weather text and of uploaded text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.config import MAX_ALTITUDE_BIAS_M, METRES_PER_HPA, STANDARD_PRESSURE_HPA

# Quality codes that reject a weather field, and the texts read as null or boolean.
BAD_QUALITY = ("2", "3", "6", "7")
NULL_TEXTS = ("", "null", "none", "nan", "na")
TRUE_TEXTS = ("true", "1")
FALSE_TEXTS = ("false", "0")


def field(text, index: int) -> Column:
    return F.get(F.split(F.coalesce(F.col(text), F.lit("")), ","), F.lit(index))


def good(quality: Column) -> Column:
    return ~F.trim(F.coalesce(quality, F.lit(""))).isin(*BAD_QUALITY)


def _digits(text: Column, missing: str) -> Column:
    return F.when(text.rlike("^[0-9]+$") & (text != missing), text.try_cast("long"))


def _has(text, n: int) -> Column:
    return F.size(F.split(F.coalesce(F.col(text), F.lit("")), ",")) >= n


def wind_direction(text="WND") -> Column:
    value = _digits(field(text, 0), "999")
    return F.when(_has(text, 5) & value.between(0, 360) & good(field(text, 1)), F.pmod(value, F.lit(360)).cast("double"))


def wind_speed(text="WND") -> Column:
    return F.when(_has(text, 5) & good(field(text, 4)), _digits(field(text, 3), "9999") / 10.0)


def station_pressure(text="MA1") -> Column:
    value = _digits(field(text, 0), "99999") / 10.0
    return F.when(_has(text, 2) & good(field(text, 1)) & value.between(850.0, 1100.0), value)


def report_pressure(text="REM") -> Column:
    """The Q group of the raw report, in hPa."""
    found = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?:^|\s)Q(\d{4})(?=\s|=|$)", 1)
    value = found.try_cast("double")
    return F.when(value.between(850.0, 1100.0), value)


def signed_tenths(text) -> Column:
    raw, quality = field(text, 0), field(text, 1)
    missing = F.regexp_replace(raw, r"^[+-]+", "") == "9999"
    return F.when((raw != "") & ~missing & good(quality), raw.try_cast("int") / 10.0)


def weather_columns() -> dict[str, Column]:
    """All decoded fields of a text report; the pressure is dropped when the two sources disagree."""
    qnh, metar = station_pressure(), report_pressure()
    delta = F.abs(qnh - metar)
    mismatch = F.coalesce(delta > 0.6, F.lit(False))
    wind_dir, wind_spd, temp, dew = wind_direction(), wind_speed(), signed_tenths("TMP"), signed_tenths("DEW")
    reasons = F.array_compact(F.array(
        F.when(wind_dir.isNull(), "wind_direction_missing_or_variable"),
        F.when(wind_spd.isNull(), "wind_speed_missing"),
        F.when(qnh.isNull(), "ma1_qnh_missing"),
        F.when(qnh.isNotNull() & metar.isNull(), "raw_metar_qnh_cross_check_unavailable").when(mismatch, "ma1_raw_metar_qnh_mismatch"),
        F.when(temp.isNull(), "temperature_missing"),
        F.when(dew.isNull(), "dew_point_missing")))
    return {
        "wind_from_deg": wind_dir, "wind_speed": wind_spd, "qnh_hpa": F.when(~mismatch, qnh), "metar_qnh_hpa": metar,
        "qnh_delta": delta, "qnh_matches": delta <= 0.6, "temperature_c": temp, "dew_point_c": dew, "missing_reasons": reasons,
    }


def qnh_bias_m(qnh="qnh_hpa") -> Column:
    return (F.lit(STANDARD_PRESSURE_HPA) - F.col(qnh)) * METRES_PER_HPA


def supported_bias(qnh="qnh_hpa") -> Column:
    return F.when(F.abs(qnh_bias_m(qnh)) <= MAX_ALTITUDE_BIAS_M, qnh_bias_m(qnh))


def headwind(wind_from="wind_from_deg", speed="wind_speed", bearing="bearing") -> Column:
    return F.col(speed) * F.cos(F.radians(F.pmod(F.col(wind_from) - F.col(bearing), F.lit(360.0))))


def crosswind_from_right(wind_from="wind_from_deg", speed="wind_speed", bearing="bearing") -> Column:
    return F.col(speed) * F.sin(F.radians(F.pmod(F.col(wind_from) - F.col(bearing), F.lit(360.0))))


def clean_text(name) -> Column:
    """Trimmed text, null for every text that stands for null."""
    text = F.trim((F.col(name) if isinstance(name, str) else name).cast("string"))
    return F.when(~F.lower(text).isin(*NULL_TEXTS), text)


def number_of(text: Column) -> Column:
    """A finite double or null from cleaned text."""
    value = text.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def clean_number(name) -> Column:
    """A finite double or null."""
    return number_of(clean_text(name))


def clean_boolean(name, null_is_false: bool = False) -> Column:
    return boolean_of(clean_text(name), null_is_false)


def boolean_of(cleaned: Column, null_is_false: bool = False) -> Column:
    """Both known texts come first: reading a text that is no number costs an error."""
    text = F.lower(cleaned)
    number = text.try_cast("double")
    value = F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False).when(number == 1.0, True).when(number == 0.0, False)
    return F.when(text.isNull(), False).otherwise(value) if null_is_false else value


def nan_to_null(df, *names):
    """Only nulls mean missing from here on."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
