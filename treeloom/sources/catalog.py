"""Table catalog: fixed schemas of the versioned model and Parquet readers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """Schema plus the metadata Spark lacks: key, references, seed rows and the dedup flag."""

    name: str
    ddl: str
    primary: tuple[str, ...]
    foreign: tuple[tuple[str, str, str], ...] = ()
    seed: tuple[tuple, ...] = ()
    no_duplicate: bool = False
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(c.split()[0] for c in self.ddl.split(",")))


#: Names of the node types, numbered from 0.
NODE_TYPES = (
    "Undefined C_Compound C_Comment C_Keyword C_SCauto C_SCregister C_SCstatic C_SCextern C_SC_Thread_local "
    "C_SCthread_local C_SCtypedef C_SCconstexpr C_FSinline C_FS_Noreturn C_AS__Alignas C_AS_alignas C_Qconst "
    "C_Qvolatile C_Qrestrict C_Q_Atomic C_functionproto C_functionprotodecl C_functionprotnotbind C_array "
    "C_arrayempty C_enumequal C_pointer C_struct C_structdecl C_structnotbind C_enum C_enumdecl C_enumnotbind "
    "C_union C_uniondecl C_unionnotbind C_void C_unsigned C_signed C_char C_short C_int C_long C_bool C_float "
    "C_double CPPro_if CPPro_elif CPPro_else CPPro_endif CPPro_ifdef CPPro_ifndef CPPro_elifdef CPPro_elifndef "
    "CPPro_define CPPro_define_macro CPPro_undef CPPro_include CPPro_line CPPro_error CPPro_warning CPPro_pragma "
    "ASM_Macro ASM_Directive ASM_Instruction ASM_Label ASM_Comment"
).split()

#: Tables of the model with their columns, keys, references and first rows.
SPECS = {
    s.name: s
    for s in (
        TableSpec("m_v_main", "vid int, vname string", ("vid",), (), ((0, "latest"),), True),
        TableSpec("m_file_name", "fnid long, fname string", ("fnid",), (), ((0, ""),), True),
        TableSpec("m_file", "fid long, vid_s int, vid_e int, ftype short, s_stat string, e_stat string", ("fid",), (("vid_s", "m_v_main", "vid"), ("vid_e", "m_v_main", "vid")), ((0, 0, 0, 0, "0", "0"),)),
        TableSpec("m_bridge_file", "vid int, fnid long, fid long", ("vid", "fnid"), (("vid", "m_v_main", "vid"), ("fnid", "m_file_name", "fnid"), ("fid", "m_file", "fid"))),
        TableSpec("m_moved_file", "s_fid long, e_fid long", ("s_fid", "e_fid"), (("s_fid", "m_file", "fid"), ("e_fid", "m_file", "fid"))),
        TableSpec("m_type_descriptor", "type_id short, name string", ("type_id",), (), tuple(enumerate(NODE_TYPES))),
        TableSpec("m_ast", "ast_id long, name string, type_id short", ("ast_id",), (("type_id", "m_type_descriptor", "type_id"),), ((0, "", 0),)),
        TableSpec("m_ast_container", "ast_id long, priority int, type_id short, ref_ast_id long", ("ast_id", "priority"), (("ast_id", "m_ast", "ast_id"), ("ref_ast_id", "m_ast", "ast_id"), ("type_id", "m_type_descriptor", "type_id"))),
        TableSpec("m_ast_include", "ast_id long, fnid long", ("ast_id",), (("ast_id", "m_ast", "ast_id"), ("fnid", "m_file_name", "fnid"))),
        TableSpec("m_ast_debug", "ast_id long, ast_raw string", ("ast_id",), (("ast_id", "m_ast", "ast_id"),)),
        TableSpec("m_tag", "tag_id long, vid_s int, vid_e int, code string, ast_id long, hl_s int, hl_l int", ("tag_id", "vid_s"), (("ast_id", "m_ast", "ast_id"), ("vid_s", "m_v_main", "vid"), ("vid_e", "m_v_main", "vid")), ((0, 0, 0, "", 0, 0, 0),)),
        TableSpec("m_bridge_tag", "fid long, tag_id long, line_s int, line_e int, char_s int, char_e int", ("fid", "tag_id"), (("fid", "m_file", "fid"), ("tag_id", "m_tag", "tag_id"))),
        TableSpec("m_map_ast", "map_id long, line_s int, char_s int, line_e int, char_e int, ast_id long", ("map_id", "line_s", "char_s", "line_e", "char_e", "ast_id"), (("ast_id", "m_ast", "ast_id"),), ((0, 0, 0, 0, 0, 0),)),
        TableSpec("m_bridge_map", "tag_id long, map_id long", ("tag_id", "map_id"), (("tag_id", "m_tag", "tag_id"), ("map_id", "m_map_ast", "map_id"))),
    )
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the files carry the schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed(spark: SparkSession, name: str) -> DataFrame:
    """The seed rows of a table of the model, with its schema."""
    spec = SPECS[name]
    return spark.createDataFrame([tuple(r) for r in spec.seed], spec.ddl)


def type_descriptor(spark: SparkSession) -> DataFrame:
    return seed(spark, "m_type_descriptor")


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    """Registered names that the session catalog lacks (names only, bounded by the model)."""
    there = {t.name for t in spark.catalog.listTables()}
    return [n for n in names if n not in there]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table as rows (table_name, n)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def counts_or_errors(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(table_name, n, error): the row count of every table that can be read; what cannot has a null count and ``Error``."""
    rows = []
    for name in names:
        try:
            rows.append((name, table(spark, sf_dir, name).count(), None))
        except Exception as e:  # noqa: BLE001 - a table that fails must not hide the others
            rows.append((name, None, f"Error: {type(e).__name__}"))
    return spark.createDataFrame(rows, "table_name string, n long, error string")
