"""The pipeline's stages on the smallest tables: what each must keep, and that nothing else is lost."""

import re

import pytest

import corpus_pipeline
from weftline.llm import decontaminate, language, line_dedup, minhash
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES:
        after = step(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def test_names_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for before, after in kept[:-1]:
        assert after.dtypes == before.dtypes and after.count() <= before.count()


def test_language_rejects_only_what_it_cannot_name(kept):
    before, after = kept[0]
    found = language.predict(before, language.fit(before)).where(f"lang_pred = 'und' or score < {corpus_pipeline.LEAST_LANGUAGE_SCORE}")
    gone = {r[0] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert gone == {r["doc_id"] for r in found.collect()}


def test_lines_against_all_runs(kept):
    """A run of 3 lines, of fewer that hold 50 words, or of all lines of a short document, is deleted where it came before."""
    before, after = kept[1]
    seen, want = set(), {}
    for r in before.orderBy("doc_id").collect():
        lines = (r["text"] or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(line_dedup.BLANKS)]
        text, gone = [lines[i].strip(line_dedup.BLANKS) for i in at], set()
        for n in range(1, min(line_dedup.RUN, len(at)) + 1):
            for s in range(len(at) - n + 1):
                run = tuple(text[s : s + n])
                if n == min(line_dedup.RUN, len(at)) or len(" ".join(run).encode().split()) >= line_dedup.LONG:
                    if run in seen:
                        gone |= set(at[s : s + n])
                    seen.add(run)
        want[r["doc_id"]] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want


def test_one_of_each_group_stays(kept):
    before, after = kept[2]
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(before, percent=corpus_pipeline.NEAR_PERCENT).collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {d for d, c in groups.items() if d == c}


def test_near_copies_at_four_fifths(spark, kept):
    """The stage against brute-force Jaccard at 0.8, over its own input and pairs of 0.80 to 0.85."""
    text = " ".join(f"word{i}" for i in range(104))
    edited = [" ".join(f"edit{i}" if i in at else f"word{i}" for i in range(104)) for at in ((20, 60), (), (1, 30, 60, 90))]
    before = kept[2][0]
    extra = spark.createDataFrame([(10**9 + i, t, "en", "a", len(t)) for i, t in enumerate([text, *edited])], before.schema)
    both = before.unionByName(extra)
    sets = {}
    for r in both.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    between = 0
    for a in sorted(sets):
        for b in sets:
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and union and 100 * common >= 80 * union:
                between += 100 * common < 85 * union
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r[0] for r in corpus_pipeline.near_dedup(spark, both, SF).select("doc_id").collect()}
    assert between and got == {d for d in sets if find(d) == d}


def test_no_item_is_left(spark, kept):
    before, after = kept[3]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(x in decontaminate.normal(t) for x in items)
    assert not any(holds(r["text"]) for r in after.collect())
    dirty = {r[0] for r in decontaminate.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert before.count() - after.count() == len(dirty) and {r["doc_id"] for r in before.collect() if holds(r["text"])} <= dirty


def test_every_token_is_packed(spark, kept):
    before, pieces = kept[4]
    by = {r["doc_id"]: r for r in pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()}
    assert set(by) == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in by.values())
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_empty_tables(spark, tmp_path):
    """Without documents, or with nothing but null and empty texts, every stage gives a result of the same columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, None, None, "s", None)], docs.schema)
    for name, step in corpus_pipeline.STAGES:
        done = step(spark, odd, str(tmp_path))
        assert done.count() == (0 if name == "language_id" else 4)
        assert name == "packing" or done.columns == docs.columns


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(ORACLES) <= set(QUERIES)
