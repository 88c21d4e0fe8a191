"""Text chunking by bytes, and chunk headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions.golang import chunk_go
from spindrift.session import over_batches, ship

SIZE, MIN_TAIL = 400, 50
WEB_CAP, WEB_MIN = 3500, 300


def chunk_text(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Chunks of SIZE bytes: keep..., j, start_line, end_line, body (binary).

    A newline that ends a window goes to the next chunk, unless it ends the text. The tail stays
    from MIN_TAIL bytes on. Cuts follow from the length alone, so each chunk is sliced by itself.
    """
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))
    n = F.length("_b")
    m = (n / SIZE).cast("int")
    last = F.when(n - m * SIZE >= MIN_TAIL, m).otherwise(m - 1)
    d = d.select(*keep, "_b", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("j"))
    cut = f"if({{0}} * {SIZE} < length(_b) and {{0}} > 0 and substring(_b, {{0}} * {SIZE}, 1) = X'0A', {{0}} * {SIZE} - 1, least({{0}} * {SIZE}, length(_b)))"
    d = d.withColumn("_a", F.expr(cut.format("j"))).withColumn("_z", F.expr(cut.format("(j + 1)")))

    def lines(to: str) -> Column:
        # newlines are ASCII, so they count the same in a one-byte charset
        s = f"decode(substring(_b, 1, {to}), 'ISO-8859-1')"
        return F.expr(f"1 + length({s}) - length(replace({s}, '\\n', ''))")

    return d.select(
        *keep, "j", lines(f"j * {SIZE}").cast("int").alias("start_line"), lines(f"least(length(_b), (j + 1) * {SIZE})").cast("int").alias("end_line"),
        F.expr("substring(_b, _a + 1, _z - _a)").alias("body"),
    )


def format_chunk(path: Column, start: Column, end: Column, body: Column, symbol: Column | None = None, kind: Column | None = None) -> Column:
    symbol = F.lit("") if symbol is None else symbol
    kind = F.lit("") if kind is None else kind
    head = F.when(symbol != "", F.concat(F.lit("Symbol: "), symbol, F.lit("\nKind: "), kind, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\n"), head, F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), body)


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, content binary or string) -> path, start_line, end_line, symbol, kind, text. Go sources
    by function, all else, and Go that doesn't parse, by bytes."""
    ship(files.sparkSession)
    go = tx.extension(F.col("path")) == ".go"
    parse = over_batches(chunk_go, "array<struct<start_line:int,end_line:int,symbol:string,kind:string,body:string>>")
    source = files.select("path", F.col("content").cast("string").alias("content"))
    parsed = source.where(go).withColumn("parts", parse("content"))
    by_func = parsed.where("parts is not null").select("path", F.explode("parts").alias("p")).select(
        "path", "p.start_line", "p.end_line", "p.symbol", "p.kind", format_chunk(F.col("path"), F.col("p.start_line"), F.col("p.end_line"), F.col("p.body"), F.col("p.symbol"), F.col("p.kind")).alias("text")
    )
    rest = source.where(~go).unionByName(parsed.where("parts is null").select("path", "content"))
    c = chunk_text(rest, "content", "path")
    by_bytes = c.select("path", "start_line", "end_line", F.lit("").alias("symbol"), F.lit("").alias("kind"), format_chunk(F.col("path"), F.col("start_line"), F.col("end_line"), F.expr("make_valid_utf8(cast(body as string))")).alias("text"))
    return by_func.unionByName(by_bytes)


def web_chunks(text: Column, cap: int = WEB_CAP) -> Column:
    """Paragraphs joined until a chunk already exceeds cap bytes (a soft cap)."""
    paragraphs = F.array_remove(F.transform(F.split(text, "\n\n", -1), tx.trim), "")
    none = F.array().cast("array<string>")
    fold = F.aggregate(
        paragraphs,
        F.struct(F.lit("").alias("cur"), none.alias("out")),
        lambda a, p: F.when(F.octet_length(a["cur"]) > cap, F.struct(p.alias("cur"), F.array_append(a["out"], a["cur"]).alias("out")))
        .otherwise(F.struct(F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p)).alias("cur"), a["out"].alias("out"))),
    )
    return F.transform(F.array(fold), lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.array_append(a["out"], a["cur"])))[0]
