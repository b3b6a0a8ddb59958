"""Position of the sun from UTC microseconds; angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400.0


def _ts(utc_us: Column) -> Column:
    return F.timestamp_micros(utc_us)


def second_of_day(utc_us: Column) -> Column:
    return F.pmod(utc_us, F.lit(86_400_000_000)) / 1e6


def mean_solar_time(utc_us: Column, lon: Column) -> Column:
    """Seconds of the day at a longitude; a degree is four minutes."""
    return F.pmod(second_of_day(utc_us) + lon * 240, F.lit(DAY_S))


def day_of_year(utc_us: Column) -> Column:
    return F.dayofyear(_ts(utc_us))


def year_angle(utc_us: Column) -> Column:
    year = F.year(_ts(utc_us)) - 1985
    first = 79.6764 + 0.2422 * year - F.floor(0.25 * year)
    return 2 * math.pi * (day_of_year(utc_us) - first) / 365.2422


#: Fourier coefficients of the declination (degrees) and of the equation of time (minutes):
#: the constant, then sine and cosine of one, two and three times the year angle.
DECLINATION = (0.3723, (23.2567, -0.7580), (0.1149, 0.3656), (-0.1712, 0.0201))
EQUATION = (0.0028, (-1.9857, -7.0924), (9.9059, -0.6882))


def _fourier(angle: Column, coefficients: tuple) -> Column:
    total = F.lit(coefficients[0])
    for k, (sine, cosine) in enumerate(coefficients[1:], 1):
        total = total + sine * F.sin(k * angle) + cosine * F.cos(k * angle)
    return total


def declination(utc_us: Column) -> Column:
    return _fourier(year_angle(utc_us), DECLINATION)


def equation_of_time(utc_us: Column) -> Column:
    """Minutes by which the sun is ahead of the mean sun."""
    return _fourier(year_angle(utc_us), EQUATION)


def apparent_solar_time(utc_us: Column, lon: Column) -> Column:
    return F.pmod(mean_solar_time(utc_us, lon) + equation_of_time(utc_us) * 60, F.lit(DAY_S))


def hour_angle(utc_us: Column, lon: Column) -> Column:
    """From whole minutes of the mean solar time; seconds are ignored."""
    return F.floor(mean_solar_time(utc_us, lon) / 60) / 4 - 180


def zenith(utc_us: Column, lat: Column, lon: Column) -> Column:
    d, h = F.radians(declination(utc_us)), F.radians(hour_angle(utc_us, lon))
    c = F.sin(F.radians(lat)) * F.sin(d) + F.cos(F.radians(lat)) * F.cos(d) * F.cos(h)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def azimuth(utc_us: Column, lat: Column, lon: Column) -> Column:
    """By its sine, so within 90 degrees of the meridian."""
    s = -F.sin(F.radians(hour_angle(utc_us, lon))) * F.cos(F.radians(declination(utc_us)))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(s, F.sin(F.radians(zenith(utc_us, lat, lon))))))))


def noon_zenith(utc_us: Column, lat: Column) -> Column:
    return F.abs(lat - declination(utc_us))


def hour_of_time(text: Column) -> Column:
    """Hours with minutes as a fraction, of a text HH:mm..."""
    return F.substring(text, 1, 2).cast("int") + F.substring(text, 4, 2).cast("int") / 60.0
