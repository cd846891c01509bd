"""Tangent-plane sky coordinates with a CD matrix, in closed form and degrees.

A header is a struct column with crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22. `origin` is the
number of the first pixel: 1 as in headers, 0 for array positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")


def header(**values: float) -> Column:
    return F.struct(*(F.lit(float(values[k])).alias(k) for k in FIELDS))


def pix_to_sky(x: Column, y: Column, wcs: Column, origin: int = 1) -> tuple[Column, Column]:
    """(ra, dec) of a pixel position."""
    u = x + (1 - origin) - wcs["crpix1"]
    v = y + (1 - origin) - wcs["crpix2"]
    xi = F.radians(wcs["cd11"] * u + wcs["cd12"] * v)
    eta = F.radians(wcs["cd21"] * u + wcs["cd22"] * v)
    dec0 = F.radians(wcs["crval2"])
    below = F.cos(dec0) - eta * F.sin(dec0)
    ra = wcs["crval1"] + F.degrees(F.atan2(xi, below))
    dec = F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + below * below)))
    return ra, dec


def sky_to_pix(ra: Column, dec: Column, wcs: Column, origin: int = 1) -> tuple[Column, Column]:
    """(x, y) of a sky position on the same side of the sky as the tangent point."""
    a, d, d0 = F.radians(ra - wcs["crval1"]), F.radians(dec), F.radians(wcs["crval2"])
    cosine = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / cosine)
    eta = F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / cosine)
    det = wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]
    u = (wcs["cd22"] * xi - wcs["cd12"] * eta) / det
    v = (wcs["cd11"] * eta - wcs["cd21"] * xi) / det
    return u + wcs["crpix1"] - (1 - origin), v + wcs["crpix2"] - (1 - origin)


def cutout_header(wcs: Column, x0: Column, y0: Column) -> Column:
    """The header of a window that starts at array position (x0, y0)."""
    return wcs.withField("crpix1", wcs["crpix1"] - x0).withField("crpix2", wcs["crpix2"] - y0)


def move_pixels(x: np.ndarray, y: np.ndarray, of: dict[str, float], to: dict[str, float], origin: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) in the grid of header `to` of pixel positions in the grid of `of`, through the sky, for arrays: headers as numbers by name."""
    u, v = x + (1 - origin) - of["crpix1"], y + (1 - origin) - of["crpix2"]
    xi, eta = np.radians(of["cd11"] * u + of["cd12"] * v), np.radians(of["cd21"] * u + of["cd22"] * v)
    dec0 = np.radians(of["crval2"])
    below = np.cos(dec0) - eta * np.sin(dec0)
    ra = of["crval1"] + np.degrees(np.arctan2(xi, below))
    dec = np.arctan2(np.sin(dec0) + eta * np.cos(dec0), np.sqrt(xi * xi + below * below))
    a, d0 = np.radians(ra - to["crval1"]), np.radians(to["crval2"])
    cosine = np.sin(dec) * np.sin(d0) + np.cos(dec) * np.cos(d0) * np.cos(a)
    xi = np.degrees(np.cos(dec) * np.sin(a) / cosine)
    eta = np.degrees((np.sin(dec) * np.cos(d0) - np.cos(dec) * np.sin(d0) * np.cos(a)) / cosine)
    det = to["cd11"] * to["cd22"] - to["cd12"] * to["cd21"]
    return (to["cd22"] * xi - to["cd12"] * eta) / det + to["crpix1"] - (1 - origin), (to["cd11"] * eta - to["cd21"] * xi) / det + to["crpix2"] - (1 - origin)
