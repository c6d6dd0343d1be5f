"""Access-log analytics on Spark: parse, featurize, score and report requests.

Every public operator takes DataFrames and returns DataFrames.  Operators do no
I/O of their own; reading lives in ``sources``, writing in ``sinks`` and the
continuous pipeline in ``streaming``.
"""

__version__ = "0.1.0"
