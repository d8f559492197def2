"""basketry — commerce analytics on Spark.

Raw customer / product / campaign / event / transaction tables go through
explicit cleaning rules (``plans.clean``) and feed a catalogue of
exploratory, business and mart operators (``plans.explore``,
``plans.business``, ``plans.marts``). Every operator is a pure
``DataFrame -> DataFrame`` function built on the DataFrame API, so the work
is planned by Catalyst and runs distributed.
"""

from basketry.plans.registry import ENTRIES, Tables, run_entry

__all__ = ["ENTRIES", "Tables", "run_entry"]
