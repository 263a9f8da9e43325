"""Table function over an index answer, for use in SQL with a lateral join.

It is a SQL function, so a lateral join with it stays inside the JVM.
``operators.captures.parse_index_lines`` does the same for jobs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from newsloom import fixed_values as fv


def register_archive_lines(spark: SparkSession, name: str = "archive_lines") -> None:
    """Make ``name(text)`` known to SQL: one row per line of seven fields."""
    columns = ", ".join(f"`{field}` STRING" for field in fv.CAPTURE_FIELDS)
    fields = ", ".join(f"f[{i}]" for i in range(len(fv.CAPTURE_FIELDS)))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(body STRING) RETURNS TABLE({columns}) RETURN "
        f"SELECT {fields} FROM (SELECT split(line, ' ', -1) AS f FROM "
        f"(SELECT explode(split(body, '\\n', -1)) AS line)) WHERE size(f) = {len(fv.CAPTURE_FIELDS)}"
    )
