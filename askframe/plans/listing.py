"""Listings over several tables: ``SELECT DISTINCT`` over a tree of joins, without an exchange of all combinations.

Where two tables hang on a third by its key, each row of one meets each of the other, and a DISTINCT over that moves every
combination though hardly any is met twice.  Here each outer table (with one join) is made distinct before the join, as are the inner
ones together.  Where what is shown of the inner tables has one set of keys only, the combinations are distinct as they are;
those of other inner rows, that show the same but have several sets of keys, are made distinct as before.  The rows are those of the
statement, whatever the keys and names are like.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORM = re.compile(r"SELECT DISTINCT (\w+\.\w+(?:, \w+\.\w+)*) FROM (\w+)((?: JOIN \w+ ON \w+\.\w+ = \w+\.\w+){2,})", re.ASCII)
_JOIN = re.compile(r" JOIN (\w+) ON (\w+)\.(\w+) = (\w+)\.(\w+)", re.ASCII)
#: Bytes of a table, by Spark's estimate, up to which it is broadcast.
SMALL = 16 << 20


def _estimate(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _estimate(df) <= SMALL else df


def listing(spark: SparkSession, sql: str) -> DataFrame | None:
    """The rows of a statement of that form, in columns without names of their own; None for any other statement."""
    m = _FORM.fullmatch(sql)
    if not m:
        return None
    shown, tables, joins = [tuple(c.split(".")) for c in m[1].split(", ")], [m[2]], []
    for new, a, left, b, right in _JOIN.findall(m[3]):
        if new in tables or a not in tables or b != new:
            return None
        tables.append(new)
        joins.append(((a, left), (b, right)))
    ends = [t for pair in joins for t, _ in pair]
    outer = [t for t in tables if ends.count(t) == 1]
    inner = [t for t in tables if t not in outer]
    if len({t.lower() for t in tables}) < len(tables) or len(outer) < 2 or not any(t in inner for t, _ in shown) or any(t not in tables for t, _ in shown):
        return None
    name = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*shown, *(c for pair in joins for c in pair)]))}
    table = lambda t: spark.table(t).select(*[F.col(c).alias(n) for (own, c), n in name.items() if own == t])
    leaves = {}  # by table: its key, the inner table's, and its rows
    core, known = table(inner[0]), {inner[0]}
    links = [pair for pair in joins if pair[0][0] in inner and pair[1][0] in inner]
    while links:  # inner tables are connected with each other
        pair = next(p for p in links if p[0][0] in known or p[1][0] in known)
        links.remove(pair)
        new = pair[1][0] if pair[0][0] in known else pair[0][0]
        core, known = core.join(table(new), F.col(name[pair[0]]) == F.col(name[pair[1]])), known | {new}
    for one, two in joins:
        for key, far in ((one, two), (two, one)):
            if key[0] in outer:
                own = [name[key], *dict.fromkeys(name[c] for c in shown if c[0] == key[0])]
                leaves[key[0]] = name[key], name[far], table(key[0]).select(*dict.fromkeys(own)).where(F.col(name[key]).isNotNull()).distinct()
    face, keys = list(dict.fromkeys(name[c] for c in shown if c[0] in inner)), list(dict.fromkeys(far for _, far, _ in leaves.values()))
    core = core.select(*dict.fromkeys([*face, *keys])).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).distinct()
    groups = core.groupBy(*face).agg(F.count("*").alias("_n"), *[F.first(k).alias(f"_{k}") for k in keys if k not in face])
    sole = groups.where("_n = 1").select(*face, *[F.col(f"_{k}").alias(k) for k in keys if k not in face])
    several = groups.where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in face])
    rest = core.join(several, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in face]), "left_semi")
    order = sorted(leaves, key=lambda t: _estimate(leaves[t][2]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def joined(inside: DataFrame) -> DataFrame:
        """All combinations; the largest outer table is dealt out row by row, so that no key is one task's work.  By a hash of its own:
        Spark would merge an exchange by the columns with the one of the distinct, and then cut the number of tasks."""
        key, far, rows = leaves[order[-1]]
        out = rows.repartition(tasks, F.xxhash64(*rows.columns)).join(_hint(inside), F.col(key) == F.col(far))
        for t in order[:-1]:
            key, far, rows = leaves[t]
            out = out.join(_hint(rows), F.col(key) == F.col(far))
        return out.select(*[F.col(name[c]).alias(f"s{k}") for k, c in enumerate(shown)])

    return joined(sole).unionByName(joined(rest).distinct())
