"""Stand-in tables: a property graph, a knowledge base, logs and snapshots, derived from the stored tables.

Each view is one SQL text that Spark and DuckDB both run; VIEWS names them in order of dependence.  In Spark a view is a
lazy DataFrame, so that only the columns and rows a query needs are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # --- property graph -------------------------------------------------------------------------------------------
    "g_nodes": """
        select 'region:' || r_regionkey as id, 'file' as kind, r_name as name, r_name as qualified_name, cast(null as string) as container_id,
               'geo/' || r_name as file_path, cast(r_regionkey as bigint) as start_line, cast(r_regionkey + 90 as bigint) as end_line from {region}
        union all
        select 'nation:' || n_nationkey, 'module', n_name, r_name || '.' || n_name, 'region:' || n_regionkey, 'geo/' || r_name, cast(n_nationkey * 3 as bigint), cast(n_nationkey * 3 + 20 as bigint)
        from {nation} join {region} on n_regionkey = r_regionkey
        union all
        select 'customer:' || c_custkey, 'function', c_name, n_name || '.' || c_name, 'nation:' || c_nationkey, 'nation/' || n_name, cast(c_custkey % 997 as bigint), cast(c_custkey % 997 + c_custkey % 13 as bigint)
        from {customer} join {nation} on c_nationkey = n_nationkey
        union all
        select 'supplier:' || s_suppkey, 'method', s_name, n_name || '.' || s_name, 'nation:' || s_nationkey, 'nation/' || n_name, cast(s_suppkey % 997 as bigint), cast(s_suppkey % 997 + 40 as bigint)
        from {supplier} join {nation} on s_nationkey = n_nationkey
        union all
        select 'part:' || p_partkey, 'class', p_name, p_brand || '.' || p_name, cast(null as string), 'brand/' || p_brand, cast(p_partkey % 499 as bigint), cast(p_partkey % 499 + p_size as bigint) from {part}
        union all
        select 'order:' || o_orderkey, 'variable', 'order_' || o_orderkey, o_orderpriority || '.order_' || o_orderkey, 'customer:' || o_custkey, 'tests/' || o_orderpriority || '/' || cast(floor(o_orderkey / 2000) as bigint), cast(o_orderkey % 1999 as bigint), cast(o_orderkey % 1999 + 5 as bigint)
        from {orders}""",
    "g_edges": """
        select 'order:' || o_orderkey as source, 'customer:' || o_custkey as target, 'calls' as kind, cast(null as bigint) as line, cast(1.0 as double) as confidence from {orders}
        union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'calls', cast(l_linenumber as bigint), 1 - l_discount from {lineitem}
        union all select distinct 'part:' || l_partkey, 'supplier:' || l_suppkey, 'references', cast(null as bigint), cast(1.0 as double) from {lineitem}
        union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'contains', cast(null as bigint), cast(1.0 as double) from {supplier}
        union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports', cast(c_custkey % 50 as bigint), cast(0.9 as double) from {customer}
        union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'imports', cast(1 as bigint), cast(1.0 as double) from {nation}""",
    "g_links": "select distinct source as src, target as dst from {g_edges}",
    # --- a small graph of suppliers and parts for closures --------------------------------------------------------
    "chain": "select p_partkey as id, case when p_partkey % 5 <> 0 then (p_partkey * p_partkey + 3) % (select count(*) from {part}) end as supersedes from {part}",
    # --- knowledge base -------------------------------------------------------------------------------------------
    "entities": """
        select substr({sha}(text), 1, 16) as id, doc_id as position, source as file, lang as topic,
               case cast(substr(source, 4) as int) % 5 when 0 then 'requirement' when 1 then 'spec' when 2 then 'decision' when 3 then 'component' else 'note' end as type,
               case doc_id % 4 when 0 then 'active' when 1 then 'draft' when 2 then 'archived' else 'active' end as status,
               substr(text, 1, 24) as title, substr(text, 25, 60) as summary, text as body, doc_id % 7 + 1 as revision from {documents}""",
    "relations": """
        select doc_id as source_id, (doc_id * 7 + 3) % (select count(*) from {documents}) as target_id,
               case doc_id % 3 when 0 then 'derived_from' when 1 then 'refines' else 'supersedes' end as type from {documents} where doc_id % 2 = 0""",
    "groundings": """
        select doc_id as entity_id, 'part:' || (doc_id * 13 % (select count(*) from {part})) as node_id, 0 as ordinal, case when doc_id % 5 = 0 then 'changed' when doc_id % 11 = 0 then 'missing' else 'fresh' end as health from {documents}
        union all select doc_id, 'supplier:' || (doc_id % 10), 1, case when doc_id % 9 = 0 then 'ambiguous' else 'unverified' end from {documents} where doc_id % 3 = 0""",
    # --- logs -----------------------------------------------------------------------------------------------------
    "timeline": "select event_id, ts, user_id, event_type as kind, value, props, 'log' as origin, case when event_id % 37 = 0 then event_id + 1 end as superseded_by from {events}",
    "claims": """
        select doc_id, source as file, case doc_id % 4 when 0 then 'path' when 1 then 'command' when 2 then 'dependency' else 'version' end as kind,
               'key' || (doc_id % 60) as key, 'v' || (doc_id % 7 % 3) as value, doc_id % 10 = 0 as negated, n_chars % 400 as line from {documents}""",
    "commits": "select 'brand/' || p_brand as file, o_orderdate as ts, l_orderkey as commit_id from {lineitem} join {part} on l_partkey = p_partkey join {orders} on l_orderkey = o_orderkey",
    # --- snapshots ------------------------------------------------------------------------------------------------
    "snap_old": "select p_partkey as id, p_name as name, p_size as size, p_retailprice as price from {part} where p_partkey % 17 <> 3",
    "snap_new": "select p_partkey as id, p_name as name, case when p_partkey % 17 = 5 then p_size + 1 else p_size end as size, case when p_partkey % 17 = 6 then null else p_retailprice end as price from {part} where p_partkey % 17 <> 9",
}
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """Attributes are DataFrames: stored tables and VIEWS, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._held = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in TABLES:
                self._held[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                text = VIEWS[name].replace("{sha}(text)", "sha2(text, 256)")
                self._held[name] = self._spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text))})
        return self._held[name]


def duckdb_with(*names: str) -> str:
    """The WITH clause that defines the views for DuckDB, those they depend on included."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in needed:
            for n in _NAME.findall(VIEWS[name]):
                add(n)
            needed.append(name)

    for name in names:
        add(name)
    text = lambda n: _NAME.sub(lambda m: "sha256" if m[1] == "sha" else m[1], VIEWS[n])
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text(n)})" for n in needed) + " "
