"""The pipeline's stages against plain versions of what they decide, on the smallest tables."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
import xxhash
from graphspark.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = [set(r.doc_id for r in docs.select("doc_id").collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept[-1]
        kept.append(set(ids))
    gone = kept[0] - kept[1]
    assert sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(i) == 0 for i in gone) <= 0.05 * len(labels)
    assert kept[3] == kept[4] == kept[5]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_that_repeat_a_key(spark):
    """Near copies and contamination are decided for the row's text, not for its key."""
    words = lambda k: " ".join(f"w{(i * k) % 997}x{k}" for i in range(1, 120))
    rows = [(3, words(3)), (7, words(3)), (7, words(5)), (7, words(11)), (None, words(13)), (None, words(5)), (7, words(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(3, words(3)), (7, words(5)), (7, words(11)), (0, words(13))])
    passage = max(pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist(), key=len)
    rows = [(1, passage), (1, words(3)), (None, passage), (None, words(5)), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, words(3)), (None, words(5)), (2, None)} and len(kept) == 3


LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", text.translate(LOWER)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else []))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies_kept(rows):
    """Ids of the smallest row of each component, by comparing all pairs of fingerprints."""
    marks = {i: fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def clean_of_benchmark(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(t.translate(LOWER))
    windows = {tuple(w[i : i + 13]) for w in map(words, items) if w for i in range(max(1, len(w) - 12))}
    widths = {len(w) for w in windows}
    kept = set()
    for i, t in rows.items():
        own, hit = words(t), set()
        for n in widths:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(own)):
            kept.add(i)
    return kept


def test_stages_by_hand(spark, tmp_path):
    """All stages but the trained classifier against brute force, each on what its predecessor kept; clashing columns ride along."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id AS component_id", "lang AS fp", "source AS _graphspark_row")
    texts = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    items = [t or "" for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()]
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df):
        stages[name](spark, df, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    near = after("near_duplicates", docs)
    assert near.columns == docs.columns and set(texts(near)) == near_copies_kept(texts(docs))
    clean = after("decontamination", near)
    assert clean.columns == docs.columns and set(texts(clean)) == clean_of_benchmark(texts(near), items)
    masked = after("personal_data", clean)
    finder = pii.Finder(pii.trained())
    want = {i: pii.masked(t, finder.spans([t])[0]) for i, t in texts(clean).items()}
    assert texts(masked) == want and {r.doc_id: r.n_chars for r in masked.collect()} == {i: len(t) for i, t in want.items()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in after("pieces", masked).collect():
        ids = model.encode(want[r.doc_id], add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
