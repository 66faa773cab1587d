import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retentia.llm import queries, tokens, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(df, **settings):
    return sorted(map(tuple, tokens.count_tokens(df, "k", "text", PATH, **settings).collect()))


def test_query_equals_library(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_token_counts"](spark, sf).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


TEXTS = [None, "", "it's we'll  two  spaces\n\n\tend  ", "<|endoftext|> inside<|endoftext|><|endof", "x" * 900,
         "Ünïcödé ½ ² 日本語のテキスト🙂🙂  nbsp \u0085 \x1c sep", "a\r\nb " * 300, " " * 700 + "z", "1234567890" * 60,
         "word <|endoftext|>" * 60, "don't " * 200, "日本語" * 300, "é" * 300, "퟿ \U0010ffff"]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 40), (37, 30)])
def test_chunks_are_spliced_where_the_whole_text_splits(spark, library, chunk, overlap):
    """Long runs without a boundary need wider overlaps; special strings may lie across a cut."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)]
    assert counted(df, chunk=chunk, overlap=overlap) == want


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "k long, text string")
    got = tokens.count_tokens(df, "k", "text", PATH).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 2]
    assert counted(df.limit(0)) == []


def test_query_keeps_every_row_of_null_and_repeated_keys(spark, tmp_path, library):
    long, other = "some words, é 12 and more " * 8_000, "日本 other text " * 9_000
    assert min(len(long), len(other)) > 1.9 * tokens.CHUNK
    big = 2**60 + 1
    rows = [(None, "a b"), (None, long), (None, long), (None, other), (1, long), (1, long), (1, other), (1, "a b"),
            (1, "a b"), (big, "c"), (big, other), (big, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op4_token_counts"](spark, str(tmp_path)).collect()]
    size = {t: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in ("", "a b", "c", long, other)}
    want = [(k, *size[t or ""], size[t or ""][1] > 1024) for k, t in rows]
    order = lambda r: (r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_top_k_equals_sql(spark, sf_dir):
    name = "op8_pivot_top_k"
    assert oracle.compare(spark, oracle.connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


def test_top_k_edges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rows = [(i, [((i * 37) % 11 - 5) / 4.0, ((i * 13) % 7 - 3) / 2.0, i % 3 - 1.0]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf")] * 3),
             (105, [0.0, 0.0, 0.0]), (106, [1.0, 2.0]), (107, [3.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 5 = 0 or vec_id = 106"), "vec_id", "embedding", 4).collect())
    usable = {i: [int(c * 256 // 1) for c in v] for i, v in rows if i is not None and v and all(
        c is not None and abs(c) < 1e300 for c in v)}
    want = []
    for q in usable:
        if q % 5 == 0 or q == 106:
            near = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items()
                          if i != q and len(v) == len(usable[q]))[:4]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df, "vec_id", "embedding").collect() == []


def test_repeated_rows_of_top_k_count_once(spark):
    rows = [(i, [i + 1.0, 1.0]) for i in range(20)]
    df, again = (spark.createDataFrame(r, "vec_id long, embedding array<double>") for r in (rows, rows + rows[10:]))
    best = lambda *a: sorted(map(tuple, topk.top_k(*a, "vec_id", "embedding").collect()))
    want = best(df, df)
    assert len(want) == 100 and [r[2] for r in want[:5]] == [19, 18, 17, 16, 15]
    assert best(df, again) == want and best(again, df) == want and best(again, again) == want
