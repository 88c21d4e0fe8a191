"""The pipeline against a plain version of all its stages, on a small table."""

import random
import re

import corpus_pipeline
from spindrift.llm import bpe
from tests.llm import brute

WORDS = "amber basil cedar delta ember fjord grove heron inlet juniper kelp larch maple north oasis pearl quartz river stone tulip umber violet willow yarrow zephyr".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


def plain(docs, items):
    """(doc_id, ...digest) of what the last stage returns."""

    def good(row):
        _, n, chars, symbols, dup, repeat, failed = brute.op7([row])[0]
        lines = sum(bool(brute.W4.search(x)) for x in (row[1] or "").split("\n"))
        return not (failed or 10 * symbols > n or 10 * dup > 3 * lines or chars > 20 * n or chars < 2 * n)

    docs = [r for r in docs if good(r)]
    gone = brute.line_removals([r for r in docs if r[0] is not None])
    docs = [(d, t if d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in docs]
    first = {}
    marked = [(d, t, fp, group) for (d, t), (_, fp, group) in zip(docs, brute.op4(docs), strict=True)]
    for d, t, fp, group in marked:
        if d is not None:
            first[group] = min(first.get(group, (d, fp, t)), (d, fp, t))
    docs = [(d, t) for d, t, fp, group in marked if d is None or (d, fp, t) == first[group]]
    docs = [r for r, x in zip(docs, brute.op3(docs, items), strict=True) if not x[-1]]
    enc = bpe.encoding()
    return [(d, *bpe.digest(enc.encode_ordinary(t), t.encode())) for d, t in docs]


def rows():
    rng = random.Random(11)
    line = lambda n=26: " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))
    texts = {i: "\n".join(line() for _ in range(3)) for i in range(1, 13)}
    items = [(0, "What grows there? " + line(12)), (1, line(4)), (2, None), (None, line(12))]
    shared = line()
    texts[2] += "\n" + shared
    texts[5] = shared + "\n" + texts[5]  # loses its first line
    texts[6] += "\n" + shared[:-1] + "\n\n"  # and this one's last, a near copy
    texts[7] = texts[3]  # nothing is left of it
    texts[8] += "\n" + items[0][1].upper()  # a benchmark passage
    texts[9] = "too few words"
    texts[10] += " # | # | " * 9
    texts[11] = "\n".join([texts[11].split("\n")[0]] * 4)
    texts[13], texts[14], texts[15] = None, "", "word " * 60
    texts[16] = "é ü 漢字 " + line(30)
    texts[17] = texts[4] + "\n" + line()
    docs = [*texts.items(), (None, line(30)), (None, None), (18, texts[1].replace("\n", " \n"))]
    return docs, items


def write(spark, folder, docs, items):
    full = [(d, t, "en", "web", None if t is None else len(t), "k") for d, t in docs]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    docs, items = rows()
    write(spark, tmp_path, docs, items)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(plain(docs, items), key=str)
    ids = {r[0] for r in got}
    assert {1, 2, 3, 4, 5, 6, 12, 16, 17, None} <= ids and not ids & {8, 9, 10, 11, 13, 14, 15}


def test_stages_keep_columns(spark, tmp_path):
    """All but the last return the columns of documents, of an empty table too."""
    docs, items = rows()
    write(spark, tmp_path, docs[:0], items)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert re.fullmatch("doc_id,n_tokens,ids_sha256,decoded_sha256", ",".join(corpus_pipeline.run(spark, str(tmp_path)).columns))
