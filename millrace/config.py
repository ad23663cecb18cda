"""Parameters of the detector, from defaults, a properties text, or configuration triples."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    window: int = 10  #: readings of a sliding window
    iterations: int = 50  #: most k-means rounds
    transitions: int = 5  #: transitions replayed
    epsilon: float = 1e-5  #: centre movement at which k-means stops
    theta: float = 0.005  #: a window less probable than this is an anomaly
    delta: int = 1000  #: expected distance of a sensor's timestamps
    min_sequence: int = 1  #: contiguous readings before a sensor's stream starts


# Configuration keys of the parameters.
KEYS = {
    "window.size": "window",
    "iterations.max": "iterations",
    "transitions.num": "transitions",
    "convergence.threshold": "epsilon",
    "probability.treshold": "theta",
    "interArrival.delay": "delta",
    "min.sequence.length": "min_sequence",
}


def parse_properties(text: str) -> dict[str, str]:
    """key=value lines; blank lines and lines that begin with # or ! count for nothing; the last of a key wins."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def as_int_set(value: str) -> set[int]:
    """A colon-separated set of whole numbers."""
    return {int(x) for x in value.split(":") if x.strip()}


def from_settings(settings: dict[str, str], base: Params = Params()) -> Params:
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Params)}
    return replace(base, **{name: kinds[name](settings[key]) for key, name in KEYS.items() if key in settings})


def settings_of_triples(triples: DataFrame, prefix: str) -> DataFrame:
    """(key, value) of the triples whose predicate begins with ``prefix`` and whose object is a literal."""
    return triples.where(F.col("p").startswith(prefix) & F.col("o").startswith('"')).select(
        F.substring("p", len(prefix) + 1, 1_000_000).alias("key"), F.regexp_extract("o", r'^"([^"]*)"', 1).alias("value")
    )


def load_params(triples: DataFrame, prefix: str) -> Params:
    """Parameters of a configuration graph; a few rows, gathered on the driver."""
    return from_settings({r["key"]: r["value"] for r in settings_of_triples(triples, prefix).where(F.col("key").isin(*KEYS)).collect()})
