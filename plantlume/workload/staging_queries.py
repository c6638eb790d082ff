"""Staging and sinks on files: raw tables written as CSV with some records damaged, staged, exported and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import fingerprint, stack_rows
from ..sources import readers, schemas, writers
from ..session import durable_dir
from .catalog import define, final, query
from .layers import Layers
from .roles import table

# A number of these records is replaced by text before they are staged.
DAMAGED = {
    "lineas_proceso": ("capacidad_nominal_hora", "linea_id LIKE '%7'"),
    "equipos": ("potencia_nominal_kw", "equipo_id LIKE '%13'"),
    "consumos_energia_horarios": ("consumo_kwh", "equipo_id LIKE '%7'"),
    "emisiones_estimadas": ("emisiones_co2e_kg", "linea_id LIKE '%3'"),
    "produccion_turno": ("unidades_producidas", "linea_id LIKE '%4'"),
    "desvios_proceso": ("desviacion_pct", "desvio_id LIKE '%9'"),
    "paradas": ("duracion_horas", "parada_id LIKE '%5'"),
    "mantenimientos": ("horas_mantenimiento", "mantenimiento_id LIKE '%2'"),
    "contexto_operativo": ("tension_operativa_proxy", "planta_id = 'P3'"),
    "benchmark_externo_proxy": ("oee_referencia", "familia_proceso = 'Acabado'"),
    "escenarios_mejora": ("presion_demanda_indice", "escenario = 'AltaDemanda'"),
    "iniciativas_mejora": ("impacto_esperado_oee_pct", "iniciativa_id LIKE '%11'"),
    "capex_proyectos": ("capex_estimado", "proyecto_id LIKE '%8'"),
    "plantas": ("criticidad_operativa", "planta_id = 'P4'"),
}
_ROLE_SQL = {"emisiones_estimadas": "emission_hours"}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schemas.RAW_TABLES[name][0].split(", ")]


def _write_raw(spark: SparkSession, sf_dir: str, root: str, names) -> None:
    """CSV files of the raw tables, all columns of their schema in order; damaged records hold text for a number."""
    layers = Layers(spark, sf_dir)
    for name in names:
        df = layers.emissions() if name == "emisiones_estimadas" else layers.role(name)
        column, rule = DAMAGED[name]
        cells = []
        for c, kind in _columns(name):
            value = F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
            if c == column:
                value = F.when(F.expr(rule), "sin dato").otherwise(value.cast("string"))
            cells.append(value.alias(c))
        df.select(*cells).write.option("header", True).option("timestampNTZFormat", readers.TIMESTAMPS).csv(f"{root}/{name}.csv")


def _root(spark: SparkSession) -> str:
    return f"{durable_dir(spark)}/plantlume/files-{uuid.uuid4().hex}"


def _staged_sql(name: str) -> tuple[str, str]:
    """Undamaged rows of the role with the columns of the schema, and the list of columns to compare."""
    from .roles import ROLES

    text = ROLES.get(name, "")
    cells, spec = [], []
    for c, kind in _columns(name):
        has = name == "emisiones_estimadas" or f"AS {c}" in text or c in ("planta_id", "linea_id", "equipo_id") and c in _places(name)
        cells.append(c if has else f"NULL::{ {'string': 'VARCHAR', 'int': 'INT', 'double': 'DOUBLE', 'date': 'DATE'}[kind] } AS {c}")
        spec.append(f"{c}~" if kind == "double" else c)
    return f"SELECT {', '.join(cells)} FROM {_ROLE_SQL.get(name, name)} WHERE NOT ({DAMAGED[name][1]})", " ".join(spec)


def _places(name: str) -> tuple[str, ...]:
    """Place columns that the role takes from shared pieces of SQL."""
    from .roles import ROLES

    return tuple(c for c in ("planta_id", "linea_id", "equipo_id") if f"AS {c}" in ROLES[name])


def _register(name: str) -> None:
    sql, spec = _staged_sql(name)
    define(f"staged_{name}", sql)

    @query(f"stage_{name}", final(f"staged_{name}", spec))
    def staged(spark, sf):
        root = _root(spark)
        _write_raw(spark, sf, root, [name])
        good, _ = readers.read_staged(spark, root, name)
        return good


for _name in DAMAGED:
    _register(_name)


@query(
    "staging_report",
    " UNION ALL ".join(
        f"SELECT '{n}' AS tabla, count(*) FILTER (WHERE NOT ({rule})) AS good, count(*) FILTER (WHERE {rule}) AS rejected FROM {_ROLE_SQL.get(n, n)}"
        for n, (_, rule) in DAMAGED.items()
    ),
)
def staging_report(spark, sf):
    root = _root(spark)
    _write_raw(spark, sf, root, DAMAGED)
    return readers.staging_report(spark, root, list(DAMAGED))


# --- JSON documents -----------------------------------------------------------------------------
@query(
    "staged_segment_profiles",
    "SELECT c_mktsegment AS segment, count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer"
    " WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1 UNION ALL SELECT 'rejected', 1, 0 FROM (SELECT 1) WHERE EXISTS"
    " (SELECT 1 FROM customer WHERE c_mktsegment = 'FURNITURE')",
)
def staged_segment_profiles(spark, sf):
    """One JSON document per customer segment, scanned with a schema; one of them has text for its number."""
    root = _root(spark)
    profile = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("nations")
    )
    damaged = F.when(F.col("segment") == "FURNITURE", "many").otherwise(F.col("customers").cast("string"))
    number = F.when(F.col("segment") == "FURNITURE", F.concat(F.lit('"'), damaged, F.lit('"'))).otherwise(damaged)
    document = F.concat(F.lit('{"segment": '), F.to_json(F.struct("segment")).substr(F.lit(12), F.length("segment") + 2), F.lit(', "customers": '), number,
                        F.lit(', "nations": '), F.col("nations").cast("string"), F.lit("}"))
    profile.select(document.alias("value")).write.text(root)
    good, bad = readers.read_checked(spark, root, "segment string, customers bigint, nations bigint", "json")
    lost = bad.agg(F.count("*").alias("n")).where("n > 0")
    return good.unionByName(lost.select(F.lit("rejected").alias("segment"), F.col("n").alias("customers"), F.lit(0).cast("bigint").alias("nations")))


# --- sinks --------------------------------------------------------------------------------------
_EXPORTED = "nation_key total_orders total_price~"
define(
    "nation_totals",
    "SELECT c_nationkey AS nation_key, count(*) AS total_orders, sum(o_totalprice) AS total_price"
    " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)


def _nation_totals(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation_key"))
        .agg(F.count("*").alias("total_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    )


@query("exported_totals_read_back", final("nation_totals", _EXPORTED, 2), digits=2)
def exported_totals_read_back(spark, sf):
    """An ordered CSV export, published and read again."""
    root, totals = _root(spark), _nation_totals(spark, sf)
    writers.publish(totals, root, "totals", "v1", fmt="csv", order=[F.asc("nation_key")])
    return writers.read_published(spark, root, "totals", "v1", totals)


@query(
    "export_by_segment_report",
    "SELECT c_mktsegment AS segment, count(*) AS filas, 1 AS same FROM customer GROUP BY 1",
)
def export_by_segment_report(spark, sf):
    """Customers exported by segment, twice; every partition read back has the rows and the content of its source."""
    root, customer = _root(spark), table(spark, sf, "customer")
    first = writers.publish(customer, root, "customers", "v1", ["c_mktsegment"])
    again = writers.publish(customer.limit(0), root, "customers", "v1", ["c_mktsegment"])  # a rerun writes nothing
    back = writers.read_published(spark, root, "customers", "v1", customer)
    same = first == again

    def of(df: DataFrame) -> DataFrame:
        from ..operators.tables import row_code

        lane = F.conv(F.substring(F.sha2(row_code(df), 256), 1, 8), 16, 10).cast("decimal(38,0)")
        return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("filas"), F.sum(lane).alias("code"))

    source = of(customer).select("segment", F.col("code").alias("want"))
    return of(back).join(source, "segment").select(
        "segment", "filas", F.when((F.col("code") == F.col("want")) & F.lit(same), 1).otherwise(0).alias("same")
    )


# --- content fingerprints -------------------------------------------------------------------------
# Columns of the driver's tables.
TABLES = {
    "region": "r_regionkey int, r_name text",
    "nation": "n_nationkey int, n_name text, n_regionkey int",
    "customer": "c_custkey int, c_name text, c_nationkey int, c_acctbal real, c_mktsegment text",
    "supplier": "s_suppkey int, s_name text, s_nationkey int, s_acctbal real",
    "part": "p_partkey int, p_name text, p_brand text, p_type text, p_size int, p_retailprice real",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus text, o_totalprice real, o_orderdate time, o_orderpriority text",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity real, l_extendedprice real,"
    " l_discount real, l_tax real, l_returnflag text, l_linestatus text, l_shipdate time",
    "events": "event_id int, ts time, user_id int, event_type text, value real, props text",
    "documents": "doc_id int, text text, lang text, source text, n_chars int",
    "embeddings": "vec_id int, embedding reals, label int",
    "pages": "page_id int, url text, html text",
    "benchmark": "item_id int, text text",
    "labels": "doc_id int, quality int, toxic int",
    "conversations": "conv_id int, turn int, role text, text text",
}


def _real(x: str) -> str:
    fine = f"(({x} - floor({x})) * 9007199254740992)"
    return (
        f"CASE WHEN isnan({x}) THEN 'fn' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'f+' ELSE 'f-' END ELSE 'f' || floor({x})::BIGINT"
        f" || ',' || floor({fine})::BIGINT || ',' || floor(({fine} - floor({fine})) * 9007199254740992)::BIGINT END"
    )


def _code_sql(column: str, kind: str) -> str:
    body = {
        "int": f"'i' || {column}", "text": f"'s' || strlen({column}) || ':' || {column}", "time": f"'t' || epoch_us({column})",
        "real": _real(column),
        "reals": f"'a' || len({column}) || ':' || array_to_string(list_transform({column}, lambda v: coalesce({_real('v::DOUBLE')}, 'n')), '')",
    }[kind]
    return f"coalesce({body}, 'n')"


def _fingerprint_sql(name: str, columns: str) -> str:
    parts = sorted(tuple(c.strip().split()) for c in columns.split(","))
    row = " || ".join(_code_sql(f"{name}.{c}", kind) for c, kind in parts)
    lanes = " || ',' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT), 0)::VARCHAR" for k in range(8))
    return f"SELECT sha256({lanes}) AS fingerprint, count(*) AS filas, '{name}' AS asset FROM (SELECT sha256({row}) AS h FROM {name})"


@query("content_versions", " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in TABLES.items()))
def content_versions(spark, sf):
    return stack_rows(*[fingerprint(table(spark, sf, n)).withColumn("asset", F.lit(n)) for n in TABLES])
