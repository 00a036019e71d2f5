"""cohortlab: cohort, sequence-clustering and outcome analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built on the
DataFrame API (and Spark ML where a model is fitted).  Modules:

* ``cohortlab.sources``   readers / writers and the role tables derived from
  the driver's TPC-H-style tables.
* ``cohortlab.functions`` Column-level helpers (portable hash, dates, code
  grouping, vector arithmetic, p-value UDFs on summary rows).
* ``cohortlab.operators`` the DataFrame operators (cohort, sequences,
  outcomes, profiles, genetics, cluster metrics, features, clustering).
* ``cohortlab.plans``     end-to-end compositions of the operators.
* ``cohortlab.streaming`` nothing: the analyses are batch-only.
"""

__all__ = ["session"]
