"""DataFrame -> DataFrame operators (one module per area of SURVEY section 2)."""

from keelson.operators import (  # noqa: F401
    changes, drift, encode, medallion, metrics, monitor, onboard, ordered, prep, registry, split,
    synth,
)
