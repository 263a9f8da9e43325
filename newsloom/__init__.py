"""newsloom: building and analysing a news-article corpus with Spark DataFrames.

Sub-packages
------------
functions   Column -> Column building blocks (URLs, text, dates, HTML)
operators   DataFrame -> DataFrame steps (policy join, captures, quality gate, ...)
plans       whole jobs put together from operators (retrieval, parsing, reports)
sources     readers and writers for the engine's tables
streaming   incremental versions of the jobs on Structured Streaming
catalog     named queries over the shared test tables with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
