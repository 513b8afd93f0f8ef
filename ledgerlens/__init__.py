"""ledgerlens: contract-spend analytics as Spark jobs.

Layer 1 (``plans.enrich``) turns a table of public contracts into an enriched
snapshot: derived columns, universe-wide percentile thresholds, three risk
signals and an Isolation Forest score.  Layer 2 (``plans.views``,
``plans.facts``, ``plans.readings``) filters that snapshot and computes the
facts each view needs.  Filters never move a threshold.
"""

__version__ = "0.1.0"
