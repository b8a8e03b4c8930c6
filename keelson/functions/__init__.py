"""Column-level building blocks (pure ``Column -> Column`` expressions).

All of them compile to Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from keelson.functions.columns import *  # noqa: F401,F403
from keelson.functions.hashing import *  # noqa: F401,F403
