"""Data folders with empty tables, rows of nulls only, and extra columns whose names the operators use inside."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = {
    "m_v_main": "vid int, vname string", "m_file_name": "fnid long, fname string", "m_file": "fid long, vid_s int, vid_e int, ftype short, s_stat string, e_stat string",
    "m_bridge_file": "vid int, fnid long, fid long", "m_ast": "ast_id long, name string, type_id short", "m_ast_container": "ast_id long, priority int, type_id short, ref_ast_id long",
    "m_ast_include": "ast_id long, fnid long", "m_tag": "tag_id long, vid_s int, vid_e int, code string, ast_id long, hl_s int, hl_l int",
    "m_bridge_tag": "fid long, tag_id long, line_s int, line_e int, char_s int, char_e int", "m_map_ast": "map_id long, line_s int, char_s int, line_e int, char_e int, ast_id long",
    "raw_update": "upd_id long, kind string, key_id long, vid int, stat string, code string, ast_id long, ftype short, arrived_at timestamp",
    "key_log": "log_id long, tbl string, key_id long, vid int, what string, logged_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, kind string, vid int, created_at timestamp",
    "doc_label": "doc_id long, label string, reviewer string, labelled_at timestamp", "pack_capacity": "pack_id int, capacity int",
}
TYPES = {"int": pa.int32(), "long": pa.int64(), "short": pa.int16(), "string": pa.string(), "timestamp": pa.timestamp("us")}
CLASHES = "k v p d w x n c src key lo hi multi leaf node side role period rng tgt path depth count gap start upd ends doc ids piece len salt rank bad h score".split()


def value(kind, i):
    return datetime.datetime(2024, 1, 1) if kind == "timestamp" else str(i) if kind == "string" else i


def write(folder, how):
    """how: empty, nulls (rows of nulls only), mixed (each column null in turn, repeated rows) or ones (one plain row)."""
    for name, ddl in TABLES.items():
        cols = [c.split() for c in ddl.split(", ")]
        rows = {"empty": [], "nulls": [[None] * len(cols)] * 3, "ones": [[value(t, 1) for _, t in cols]]}.get(how)
        if rows is None:
            rows = [[value(t, 1 + j % 3) for _, t in cols] for j in range(4)]
            rows += [[None if i == j else value(t, 2) for j, (_, t) in enumerate(cols)] for i in range(len(cols))]
            rows += rows[:3]
        data = {c: pa.array([r[i] for r in rows], TYPES[t]) for i, (c, t) in enumerate(cols)}
        if how != "empty":
            data |= {c: pa.array(["clash"] * len(rows)) for c in CLASHES if c not in data}
        pq.write_table(pa.table(data), f"{folder}/{name}.parquet")
    return str(folder)
