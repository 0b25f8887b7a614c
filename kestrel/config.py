"""Parameters of the encounter engine. Values are passed in; nothing reads them as globals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Named regions as (least latitude, least longitude, greatest latitude, greatest longitude).
REGIONS = {
    "Boston": (41.9, -71.6, 42.7, -70.5),
    "New York": (40.3, -74.6, 41.2, -73.3),
    "Los Angeles": (33.5, -118.9, 34.5, -117.5),
    "Chicago": (41.5, -88.3, 42.3, -87.3),
    "San Francisco": (37.2, -122.7, 38.1, -121.7),
    "Seattle": (47.2, -122.8, 48.0, -121.8),
    "Miami": (25.4, -80.6, 26.3, -80.0),
    "Dallas": (32.4, -97.4, 33.2, -96.3),
    "Atlanta": (33.3, -84.9, 34.1, -83.9),
    "Denver": (39.4, -105.4, 40.2, -104.3),
    "London": (51.1, -0.9, 51.9, 0.6),
}


# The defaults of the classes below are fixed values too: the rule's distances, and the ranges of flights.


@dataclass(frozen=True)
class Separation:
    """Distances in metres, times in seconds."""

    horizontal_m: float = 200.0
    vertical_m: float = 50.0
    search_m: float = 330.0
    gap_s: float = 180.0
    bucket_s: int = 1


def cylinder_volume(radius, half_height):
    """Of numbers or Columns alike, as the two below."""
    return math.pi * radius * radius * (2 * half_height)


def sphere_radius(volume):
    return (3 * volume / (4 * math.pi)) ** (1 / 3)


def minor_axis(volume, aspect):
    """The short half-axes of an ellipsoid whose long one is ``aspect`` times as long."""
    return (3 * volume / (4 * math.pi * aspect)) ** (1 / 3)


@dataclass(frozen=True)
class Volumes:
    """Sizes of the three shapes, of one volume with the cylinder of the separation rule."""

    radius_m: float = 200.0
    half_height_m: float = 50.0
    aspect: float = 3.0

    @property
    def volume(self) -> float:
        return cylinder_volume(self.radius_m, self.half_height_m)

    @property
    def sphere_m(self) -> float:
        return sphere_radius(self.volume)

    @property
    def minor_m(self) -> float:
        return minor_axis(self.volume, self.aspect)

    @property
    def major_m(self) -> float:
        return self.aspect * self.minor_m


@dataclass(frozen=True)
class Flights:
    """Ranges that simulated flights are drawn from, arrivals per hour, attempts, and the seed."""

    speed: tuple[float, float] = (5.0, 15.0)
    altitude: tuple[float, float] = (10.0, 121.92)
    duration: tuple[float, float] = (300.0, 1500.0)
    longest_m: float = 8000.0
    per_hour: dict[str, float] = field(default_factory=lambda: {"sparse": 10.0, "medium": 50.0, "dense": 200.0})
    starts: int = 20
    bearings: int = 20
    seed: int = 42


def bbox_of(region: str) -> tuple[float, float, float, float]:
    """The box of a named region; ValueError for any other name."""
    if region not in REGIONS:
        raise ValueError(f"unknown region {region!r}; known are {', '.join(REGIONS)}")
    return REGIONS[region]


def utm_epsg(bbox: tuple[float, float, float, float]) -> int:
    """EPSG code of the UTM zone of the box's centre, without the exceptions in the north."""
    south, west, north, east = bbox
    return (32600 if (south + north) / 2 >= 0 else 32700) + int(((west + east) / 2 + 180) // 6) + 1
