"""rubric: Spark-native scoring and evaluation of step-by-step QA rollouts.

Subpackages: ``functions`` (Column functions), ``sources`` (readers,
writers, derived tables), ``operators`` (DataFrame -> DataFrame jobs),
``plans`` (registered queries, oracle SQL, pipelines), ``streaming``.
"""

__version__ = "0.1.0"
