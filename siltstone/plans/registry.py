"""All queries of the core by name, and the SQL they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import kernels, oracles, problems

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {n: f for n, f in vars(problems).items() if re.match(r"p\d+_", n)} | kernels.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_found": problems.P1_SQL, "p2_found": oracles.P2_SQL, "p3_found": oracles.P3_SQL, "p3_union_types": oracles.P3_UNION_SQL, "p3_refused": oracles.P3_REFUSED_SQL, "p4_found": problems.P4_SQL, "p4_orphans_by_month": problems.P4_MONTH_SQL} | kernels.SQL
