"""plumbrule: data quality on tables, expressed as Spark plans.

Every operator takes DataFrames and returns lazy DataFrames. Specs
(:mod:`plumbrule.spec`) are plain Python configuration.
"""

from plumbrule.spec import KeySpec, RuleSpec

__all__ = ["KeySpec", "RuleSpec"]
