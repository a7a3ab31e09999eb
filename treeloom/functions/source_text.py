"""Rows from source text: lines, directives, conditional scopes, tokens, assembly lines.

Lines are exploded with built-in functions and classified by expressions; only the C tokenizer is a Python function,
one Arrow batch at a time. There is no C parser here: declarations are spotted by shape only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.operators.extents import lines

#: Directives and the ids of their node types.
DIRECTIVES = {
    "if": 46, "elif": 47, "else": 48, "endif": 49, "ifdef": 50, "ifndef": 51, "elifdef": 52, "elifndef": 53, "define": 54,
    "undef": 56, "include": 57, "line": 58, "error": 59, "warning": 60, "warn": 60, "pragma": 61,
}
DEFINE_MACRO, ASM_MACRO, ASM_DIRECTIVE, ASM_INSTRUCTION, ASM_LABEL, ASM_COMMENT = 55, 62, 63, 64, 65, 66
OPENERS, BRANCHES = ("if", "ifdef", "ifndef"), ("elif", "elifdef", "elifndef", "else")


def source_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, code): one row per line, from 1. A null text has no lines, an empty one has one."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "code")).select(key, (F.col("pos") + 1).alias("line"), "code")


def directive(code: Column) -> Column:
    """The word of a preprocessor line, or an empty string."""
    return F.regexp_extract(code, "^[ \\t]*#[ \\t]*([a-z]+)", 1)


def directive_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, word, type_id, name, rest) of preprocessor lines.

    Unknown words are comments of assembly; ``embed`` gives no row. A define with a body is a macro. Only comments are cut, to 255 characters.
    """
    rows = source_lines(df, key, text).withColumn("word", directive(F.col("code"))).filter("word <> '' and word <> 'embed'")
    rest = F.trim(F.regexp_replace(F.col("code"), "^[ \\t]*#[ \\t]*[a-z]+", ""))
    rows = rows.withColumn("rest", rest)
    name = F.regexp_extract("rest", "^([A-Za-z_][A-Za-z_0-9]*)", 1)
    macro = (F.col("word") == "define") & F.col("rest").rlike("^[A-Za-z_][A-Za-z_0-9]*(\\(|[ \\t]+[^ \\t])")
    kind = F.when(macro, F.lit(DEFINE_MACRO))
    for w, t in DIRECTIVES.items():
        kind = kind.when(F.col("word") == w, F.lit(t))
    rows = rows.select(key, "line", "word", kind.otherwise(F.lit(ASM_COMMENT)).cast("int").alias("type_id"), name.alias("name"), "rest")
    return rows.withColumn("rest", F.when(F.col("type_id") == ASM_COMMENT, F.substring("rest", 1, 255)).otherwise(F.col("rest")))


def macro_arguments(code: Column) -> Column:
    """Arguments of a define with ``(`` right after its name, up to the bracket that closes it; commas inside brackets part
    nothing. Empty for other lines, without arguments, and where the bracket is not closed.
    """
    rest = F.regexp_extract(code, "^[ \\t]*#[ \\t]*define[ \\t]+[A-Za-z_][A-Za-z_0-9]*\\((.*)$", 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("arg"), F.array().cast("array<string>").alias("args"))

    def step(acc: Column, c: Column) -> Column:
        depth, arg, args = acc["depth"], acc["arg"], acc["args"]
        after = F.when(depth == 0, 0).when(c == "(", depth + 1).when(c == ")", depth - 1).otherwise(depth)
        ends = (depth == 1) & c.isin(",", ")")
        return F.struct(
            after.alias("depth"), F.when((depth == 0) | ends, F.lit("")).otherwise(F.concat(arg, c)).alias("arg"),
            F.when(ends, F.concat(args, F.array(arg))).otherwise(args).alias("args"),
        )

    read = F.aggregate(F.split(rest, ""), start, step)
    args = F.filter(F.transform(read["args"], lambda x: F.trim(x)), lambda x: x != "")
    return F.when(rest == "", F.array().cast("array<string>")).when(read["depth"] == 0, args).otherwise(F.array().cast("array<string>"))


def conditional_scopes(directives: DataFrame, key: str) -> DataFrame:
    """(key, line, word, line_end) of every opener and branch.

    A branch ends on the line before the next one of its group, but not before it starts; the last one ends with its
    ``endif``. Branches and endifs without an opener have no row; openers without an endif end at 0, as do their open
    branches. Depth is a running sum, so a file needs one sort and no stack.
    """
    d = directives.filter(F.col("word").isin(*OPENERS, *BRANCHES, "endif")).select(key, "line", "word")
    w = Window.partitionBy(key).orderBy("line")
    step = F.when(F.col("word").isin(*OPENERS), 1).when(F.col("word") == "endif", -1).otherwise(0)
    d = d.withColumn("sum", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Endifs that close nothing must not lower the depth of what follows: lift by the lowest sum so far.
    low = F.least(F.lit(0), F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("stray", (F.col("word") == "endif") & (F.col("sum") == low) & (low < F.coalesce(F.least(F.lit(0), F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))))
    d = d.withColumn("depth", F.col("sum") - low + F.when(F.col("word") == "endif", 1).otherwise(0)).filter("not stray and depth > 0")
    at = Window.partitionBy(key, "depth").orderBy("line")
    group = F.sum(F.when(F.col("word").isin(*OPENERS), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("grp", group)
    g = Window.partitionBy(key, "depth", "grp").orderBy("line")
    nxt, nline = F.lead("word").over(g), F.lead("line").over(g)
    end = F.when(nxt.isNull(), 0).when(nxt == "endif", nline).otherwise(F.greatest(F.col("line"), nline - 1))
    return d.withColumn("line_end", end.cast("int")).filter("word <> 'endif'").select(key, "line", "word", "line_end")


def asm_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, type_id, name) of assembly lines: label, directive, comment or instruction; blank lines have none.

    Lines from ``.macro`` to ``.endm`` are one macro, given on its first line.
    """
    rows = source_lines(df, key, text).withColumn("s", F.trim(F.regexp_replace("code", "[ \\t]+", " "))).filter(F.col("s") != "").filter(~directive(F.col("code")).isin(*DIRECTIVES))
    w = Window.partitionBy(key).orderBy("line")
    opens, closes = F.col("s").rlike("^\\.macro( |$)"), F.col("s").rlike("^\\.endm( |$)")
    before = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(before, F.lit(0)) > 0).filter("not inside")
    kind = (
        F.when(opens, ASM_MACRO).when(F.col("s").rlike("^(#|//|/\\*|;|@)"), ASM_COMMENT)
        .when(F.col("s").rlike("^[A-Za-z_.$0-9][A-Za-z_.$0-9]* ?:"), ASM_LABEL).when(F.col("s").startswith("."), ASM_DIRECTIVE).otherwise(ASM_INSTRUCTION)
    )
    return rows.select(key, "line", kind.cast("int").alias("type_id"), F.substring("s", 1, 255).alias("name"))


#: Keywords of C.
KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict "
    "return short signed sizeof static struct switch typedef union unsigned void volatile while _Atomic _Bool _Noreturn".split()
)
_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<literal>"(?:\\.|[^\\"\n])*"|'(?:\\.|[^\\'\n])*'|\.?[0-9](?:[eEpP][+-]|[\w.])*)"""
    r"""|(?P<identifier>[A-Za-z_]\w*)|(?P<punctuation>->|\+\+|--|<<=|>>=|<<|>>|[<>=!+\-*/%&|^]=|&&|\|\||\.\.\.|\#\#|[^\w\s])""",
    re.DOTALL | re.ASCII,
)


def tokens_of(text: str) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, spelling, line_s, char_s, line_e, char_e) of each token; lines end with LF."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, line = [], 0
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "identifier" and s in KEYWORDS:
            kind = "keyword"
        while line + 1 < len(starts) and starts[line + 1] <= m.start():
            line += 1
        last = line + s.count("\n")
        out.append((kind, s, line + 1, m.start() - starts[line] + 1, last + 1, m.end() - starts[last] + 1))
    return out


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, spelling, line_s, char_s, line_e, char_e) of every C token of every text.

    A null or empty text has none. Of a batch of texts one batch of tokens comes out.
    """
    kind = df.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), *[pa.int32()] * 4]
        for b in batches:
            found = [tokens_of(t) if t else [] for t in b.column(1).to_pylist()]
            sizes = [len(f) for f in found]
            columns = list(zip(*(x for f in found for x in f), strict=True)) or [()] * len(types)
            rows = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32())
            pos = pa.array([j for n in sizes for j in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pos, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "pos", "kind", "spelling", "line_s", "char_s", "line_e", "char_e"])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind.simpleString()}, pos int, kind string, spelling string, line_s int, char_s int, line_e int, char_e int")


def brace_zones(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, zone, level, pos_s, pos_e, line_s, line_e) of what stands between matching braces, from the tokens.

    ``zone`` counts opening braces from 1, ``level`` is the number of zones around and including it. A zone that is not
    closed ends at null; a closing brace without an opening one is none. One sort of the braces of each text.
    """
    braces = tokens(df, key, text).filter("spelling in ('{', '}')").select(key, "pos", F.col("line_s").alias("line"), F.when(F.col("spelling") == "{", 1).otherwise(-1).alias("step"))
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = braces.withColumn("sum", F.sum("step").over(upto))
    # Stray closing braces lift what follows them.
    d = d.withColumn("low", F.least(F.lit(0), F.min("sum").over(upto))).withColumn("was", F.coalesce(F.lag("low").over(w), F.lit(0)))
    d = d.filter("not (step = -1 and low < was)").withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0))
    d = d.withColumn("zone", F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(upto))
    at = Window.partitionBy(key, "level").orderBy("pos")
    nxt = F.lead("step").over(at)
    close = lambda c: F.when(nxt == -1, F.lead(c).over(at))
    d = d.withColumn("pos_e", close("pos")).withColumn("line_e", close("line"))
    return d.filter("step = 1").select(key, F.col("zone").cast("int").alias("zone"), F.col("level").cast("int").alias("level"), F.col("pos").alias("pos_s"), "pos_e", F.col("line").alias("line_s"), "line_e")


def condition_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, word, expression) of #if and #elif lines: the spellings of the tokens after the word, without spaces.

    Lines without a token after the word have an empty expression; comments are no tokens of it.
    """
    heads = directive_rows(df, key, text).filter("word in ('if', 'elif')").select(key, "line", "word", F.concat_ws("\u0001", F.col(key).cast("string"), F.col("line").cast("string")).alias("_at"), "rest")
    t = tokens(heads, "_at", "rest").filter("kind <> 'comment'")
    spelled = t.groupBy("_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spelling"))), lambda x: x["spelling"]), "").alias("expression"))
    return heads.join(spelled, "_at", "left").select(key, "line", "word", F.coalesce("expression", F.lit("")).alias("expression"))


def declarations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, shape, name) of lines that look like a declaration: function, struct, enum, union or variable."""
    rows = source_lines(df, key, text)
    func = "^(?:static |inline |extern )*[a-z][\\w ]*[ *]+([A-Za-z_]\\w*)\\([^;]*\\)?[^;=]*$"
    agg = "^(?:static |typedef )*(struct|enum|union) +([A-Za-z_]\\w*) *\\{"
    var = "^(?:static |extern |const )*(?:unsigned |signed )?(?:void|char|short|int|long|float|double|u8|u16|u32|u64|bool|struct +\\w+)[ *]+([A-Za-z_]\\w*) *(?:=[^;]*|\\[[^;]*)?;"
    c = F.col("code")
    shape = F.when(c.rlike(agg), F.regexp_extract(c, agg, 1)).when(c.rlike(var), "variable").when(c.rlike(func) & ~c.rlike("^(return|else|if|while|for|switch|goto)\\b"), "function")
    name = F.when(c.rlike(agg), F.regexp_extract(c, agg, 2)).when(c.rlike(var), F.regexp_extract(c, var, 1)).otherwise(F.regexp_extract(c, func, 1))
    return rows.select(key, "line", shape.alias("shape"), name.alias("name")).filter("shape is not null")
