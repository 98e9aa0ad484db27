"""slotvalue: cohort and slot-value analytics as Spark DataFrame plans.

Entrants join a yearly class at a numbered slot and later show an exposure
and a value.  The library cleans raw page tables into typed entrants, builds
stable entity keys from names, summarises value by slot, ranks entrants in
their class, sorts outcomes into bands, picks exemplars per slot and writes
report tables.  A few batch operators cover document listing and search.

Every public function takes and returns DataFrames.  Nothing here runs a job
while a plan is built, except search, which checks whether any query needs the
character-gram route.  The corpus operators in ``llm`` are an optional part.
"""

__version__ = "0.1.0"
