"""Each operator against a plain version of its contract, over a small corpus with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, cotraining, decontaminate, language, language_model, licences, line_dedup, minhash, packing, quality_rules, suffix_dedup

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rep long, anchor string, y int"


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(40)]
    long = prose(rng, 900)
    passage = prose(rng, 60)
    texts = [*base, None, "", "   \n\t ", "one two three", "ONE Two three", "?!? 123", "abé\U0001f600 " * 120, long, long + " tail", "x" * 900, "the the the " * 90]
    for i in range(12):
        words = rng.choice(base[5:15]).split()
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(9)]
    texts += ["\n".join(["first line here", "second line here", "third line here", prose(rng, 9)]) for _ in range(4)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "a", "b", None)[i % 4], 0, i, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[40]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    texts = {d: t for d, t, *_ in corpus()}
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    assert minhash.near_duplicates(empty).count() == 0


def test_blocks_find_what_the_star_leaves(spark):
    """Documents that are too far from the smallest one of their bucket, but near each other."""
    rng = random.Random(5)
    base = prose(rng, 300).split()

    def edited(places):
        words = list(base)
        for i in places:
            words[i] = f"e{i}"
        return " ".join(words)

    texts = [" ".join(base), *(edited([*range(10, 290, 18), 3 + 7 * k]) for k in range(12))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame).collect()}
    assert got[0] == 0 and {got[i] for i in range(1, 13)} == {1}


def test_suffix_dedup(docs, empty):
    L = 200
    rows = [((t or "").encode()) for _, t, *_ in corpus()]
    seen = Counter(t[i : i + L] for t in rows for i in range(len(t) - L + 1))
    want = []
    for (d, *_), t in zip(corpus(), rows, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - L + 1):
            if seen[t[i : i + L]] > 1:
                gone[i : i + L] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        want.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.dedup(empty).count() == 0


def test_split_shards_give_the_same(docs, monkeypatch):
    whole = sorted(map(tuple, suffix_dedup.dedup(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2)
    assert sorted(map(tuple, suffix_dedup.dedup(docs).collect())) == whole


def test_texts_beyond_a_kernel_slice(spark):
    """Texts longer than what a numpy kernel works on at a time, against plain versions of the contracts."""
    rng = random.Random(8)
    body, passage = prose(rng, 170_000), prose(rng, 70)
    half = len(body) // 2
    texts = [body[:half] + " " + passage + " " + body[half:], "short words " + passage + " end", None, body[half - 40 : half + 40]]
    assert len(texts[0]) > 1 << 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(rows).collect()}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        edges = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), int(gone.sum()), edges, kept)
    assert got[1]["n_removed"] > 0
    sizes = {r["doc_id"]: r["n_shingles"] for r in minhash.near_duplicates(rows).collect()}
    assert sizes == {d: len(shingles(t)) for d, t in enumerate(texts)}


def test_quality_counts(docs, empty):
    want = []
    for d, t, *_ in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)))
    got = quality_rules.quality(docs)
    assert sorted(tuple(r[:7]) for r in got.collect()) == sorted(want)
    assert not got.where("base_failed and kept").count()
    assert quality_rules.quality(empty).count() == 0


def test_weak_supervision_finds_the_rates():
    rng = random.Random(1)
    caught, votes, n_bad = [0.6, 0.5, 0.4], Counter(), 0
    for _ in range(20_000):
        bad = rng.random() < 0.15
        n_bad += bad
        votes[tuple(0 if rng.random() < (c if bad else 0.005) else -1 for c in caught)] += 1
    prior, rates = quality_rules.fit(sorted(votes.items()), 3)
    assert abs(1 - prior - n_bad / 20_000) < 0.04 and all(abs(b[0] - c) < 0.1 for (_, b), c in zip(rates, caught, strict=True))


def test_one_kind_of_junk_is_enough(spark):
    rng = random.Random(2)
    plain = lambda: re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], prose(rng, 120))
    texts = [plain() for _ in range(80)] + [re.sub(" ", "*** ", plain()) for _ in range(6)] + [plain().upper() for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality_rules.quality(frame).where("kept").collect()}
    assert kept == set(range(80))


def test_packing(docs, empty):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, *_ in corpus()}
    copies = Counter(d for d, *_ in corpus())
    rows = packing.digests(packing.pack(docs, width=64, windows=4)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    for d, n in copies.items():
        held = Counter(i for a, k, _ in by_doc[d] for i in range(a, a + k))
        assert held == Counter({i: n for i in range(len(ids[d]))}) and {x for _, _, x in by_doc[d]} == {len(ids[d])}
    for s, pieces in by_sequence.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 64 or s == max(by_sequence)
    assert packing.pack(empty).count() == 0


def test_every_window_holds_its_mixture():
    take = np.array([70_000, 20_000, 9_000, 24], dtype=np.int64)
    windows = list(packing.quotas(take, 2048))
    assert sum(windows).tolist() == take.tolist() and all(w.sum() == 2048 for w in windows[:-1])
    share = take / take.sum()
    assert max(np.abs(np.cumsum(windows, 0)[:-1] - 2048 * share * np.arange(1, len(windows))[:, None]).max(), 0) <= 3


@pytest.mark.parametrize("sources", [1, 7, 2000])
def test_sources_keep_their_share_of_every_window(spark, sources):
    """However many sources there are, each has served its share of the stream up to any window's end, across blocks, within 3 tokens."""
    rng = random.Random(sources)
    names = [f"s{int(sources * rng.random() ** 3)}" if sources > 1 else None for _ in range(6000)]
    rows = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 12)), s) for i, s in enumerate(names)], "doc_id long, text string, source string").repartition(5)
    width, windows = 512, 8
    pieces = packing.pack(rows, width=width, windows=windows).drop("ids").toPandas()
    pieces["source"] = [names[d] or "" for d in pieces["doc_id"]]
    assert pieces.groupby("sequence_id")["length"].sum().iloc[:-1].eq(width).all()
    assert pieces["sequence_id"].nunique() > 3 * windows
    held = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).sort_index()
    whole = held.to_numpy().sum()
    at = held.sum(axis=1).cumsum().to_numpy()
    due = at[:, None] * held.sum(axis=0).to_numpy()[None, :] / whole
    assert np.abs(held.cumsum().to_numpy() - due).max() <= 3


def test_line_dedup(docs, empty, spark):
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert len(got) == len(corpus())
    texts = ["a\nb\nc\nd", "x\na\n\n b\nc\ny", "a\nb", "a\nb", None, "", "\n\n", "a\nb\nc\nd"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert done == {0: "a\nb\nc\nd", 1: "x\n\ny", 2: "a\nb", 3: "", 4: None, 5: "", 6: "\n\n", 7: ""}
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_line_dedup(rows, run, long):
    """The texts that are left: every earlier place is compared with every later one, line by line, to both sides."""
    docs = []
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(line_dedup.BLANKS)]
        docs.append((d, lines, at, [lines[i].strip(line_dedup.BLANKS) for i in at]))
    words = lambda xs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in xs)
    out = {}
    for y, (d, lines, at, mine) in enumerate(docs):
        gone = set()
        for x in range(y + 1):
            theirs = docs[x][3]
            for i in range(len(mine)):
                for j in range(i if x == y else len(theirs)):
                    if mine[i] != theirs[j] or (i and j and mine[i - 1] == theirs[j - 1]):
                        continue
                    n = 1
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    whole = n == len(mine) == len(theirs) and x < y
                    if n >= run or words(mine[i : i + n]) >= long or whole:
                        gone |= set(at[i : i + n])
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_against_all_pairs_of_places(spark):
    """Runs of 3 lines or more, and of one or two that hold 50 words; the plain version extends every pair of places both ways."""
    rng = random.Random(9)
    long = [prose(rng, n) for n in (20, 30, 49, 50, 55)]
    texts = ["\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += ["\n".join(rng.choice([*long, "a", "b", "  ", *(f"own {rng.random()}" for _ in range(4))]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)), line_dedup.RUN, line_dedup.LONG)


def test_winnowing_picks_window_minima():
    rng = random.Random(4)
    for n in range(12):
        keys = [bytes([rng.randrange(3)] * 8 + [rng.randrange(256)] * 8) for _ in range(n)]
        words = np.array([rng.randrange(40) for _ in range(n)], dtype=np.int64)
        want = {}
        for size in (1, 2, 3):
            for s in range(n - size + 1):
                if size == min(3, n) or words[s : s + size].sum() >= 50:
                    least = min(keys[s : s + size], key=lambda k: k[:8])[:8]
                    want.setdefault(max(i for i in range(s, s + size) if keys[i][:8] == least), set()).add((s, size))
        assert {p: set(x) for p, x in line_dedup.winnow(words, keys, 3, 50).items()} == want


def test_line_dedup_odd_rows(spark):
    """Null ids, a hot line, texts of many lines, clashing column names."""
    names = "id copy row text later kept removed mark run _removed reach".split()
    shape = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names if n != "text") + ", `a.b` int"
    texts = [(None, "a\nb\nc"), (5, "a\nb\nc\nhot"), (6, "hot\n" * 500), (7, "\n".join(f"line {i}" for i in range(70_000))), (8, "x\nline 4\nline 5\nline 6\ny"), (None, None)]
    frame = spark.createDataFrame([(d, t, *names[1:], 1) for d, t in texts], shape)
    done = line_dedup.dedup_lines(frame)
    assert done.columns == [*frame.columns, "__removed"]
    got = {(r["doc_id"], r["text"][:12] if r["text"] else r["text"], r["__removed"]) for r in done.collect()}
    assert got == {(None, "", 3), (5, "a\nb\nc\nhot", 0), (6, "hot\nhot\nhot\n"[:4], 499), (7, "line 0\nline ", 0), (8, "x\ny", 3), (None, None, 0)}


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (90, 120))
        assert decontaminate.least_distance(p, t, 1000) == edit_distance_in(p, t)


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, None), (7, "!!"), (None, "a b c")]
    pages = []
    for i in range(40):
        w = items[i % 6][1]
        cut = list(w)
        for _ in range(rng.randrange(0, 22)):
            cut[rng.randrange(len(cut))] = rng.choice("xyz")
        pages.append((i, prose(rng, 20) + " " + "".join(cut).upper() + ".\n" + prose(rng, 20)))
    pages += [(40, None), (41, "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r[0], r[1]): r[2] for r in decontaminate.matches(spark.createDataFrame(pages, "doc_id long, text string"), tests).collect()}
    want = {}
    for d, t in pages:
        for i, x in items[:6]:
            p = decontaminate.normal(x)
            if t and (n := edit_distance_in(p, decontaminate.normal(t))) <= int(len(p) * decontaminate.BUDGET):
                want[d, i] = n
    assert found == want and len(want) > 10
    assert decontaminate.matches(empty, tests).count() == 0 and decontaminate.matches(docs, tests.limit(0)).count() == 0


def test_licences(spark, docs, empty):
    texts = ["prose here\nReleased under the MIT License.", "LICENSED under the apache license version 2.0", "nothing", None, "", "MIT"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r[0], r[1]) for r in licences.scan(frame).collect()} == {(0, "MIT"), (1, "Apache-2.0")}
    assert licences.scan(docs).count() == 0 and licences.scan(empty).count() == 0
    a, b = licences.bigrams("a b c d"), licences.bigrams("a b c e")
    assert licences.dice(a, b) == pytest.approx(4 / 6)


def test_language(spark, empty):
    rng = random.Random(8)
    words = {"en": "the of and to in that house water stone".split(), "de": "der die und nicht haus wasser stein ist".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(20)), g) for i in range(400) for g in [("en", "de")[i % 2]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "nichts steinhaus", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(frame).collect()}
    assert sum(got[i]["lang_pred"] == g for i, _, g in rows[:400]) >= 398
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert got[1002]["lang_pred"] == "de"
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert language.identify(empty).count() == 0


def test_cotraining(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80) if i % 3 else "BUY!! " * 80, "en", f"s{i % 5}", 0) for i in range(300)] + [(900, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.classify(frame, labels, exchange=20).collect()}
    assert len(got) == 301 and sum(got[i]["predicted"] == int(i % 3 > 0) for i in range(150, 300)) >= 147
    assert cotraining.classify(docs, labels.limit(0)).count() == len(corpus()) and cotraining.classify(empty, labels).count() == 0


def test_masked_lm(spark, docs, empty, monkeypatch):
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    assert got[40]["n_tokens"] == 0 and got[40]["mean_log_likelihood"] is None and all(np.isfinite(r["log_likelihood"]) and r["log_likelihood"] <= 0 for r in got.values())
    assert language_model.score(empty).count() == 0
    rng = np.random.default_rng(0)
    net = language_model.start(rng.integers(1, 50, language_model.PAD).astype(float))
    l2, l1, r1, r2 = rng.integers(0, language_model.PAD, 4)
    docs = [np.array([l2, l1, x, r1, r2]) for x in range(language_model.PAD)]
    chances = language_model.log_chances(net, language_model.stream(docs)).reshape(-1, 5)[:, 2]
    assert np.exp(chances.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    text = language_model.stream([np.array([5, 9, 200, 7, 31] * 400)])
    before = language_model.log_chances(net, text).mean()
    for _ in range(30):
        language_model.log_chances(net, text, 0.5)
    assert language_model.log_chances(net, text).mean() > before + 1


def test_masked_lm_slopes():
    """A step's change of each part of the network points down the slope that finite differences give."""
    rng = np.random.default_rng(3)
    net = {k: v.astype(np.float64) for k, v in language_model.start(rng.integers(1, 9, language_model.PAD).astype(float)).items()}
    docs = [rng.integers(0, language_model.PAD, n) for n in (7, 1, 12)]
    part = language_model.stream(docs)
    loss = lambda: -language_model.log_chances(net, part).astype(np.float64).sum()
    stepped = {k: v.copy() for k, v in net.items()}
    language_model.log_chances(stepped, part, 1e-3)
    for name, _ in language_model._PARTS:
        moved = np.argwhere(stepped[name] != net[name])
        for at in map(tuple, moved[rng.permutation(len(moved))[:5]]):
            was, eps = net[name][at], 1e-2
            net[name][at] = was + eps
            up = loss()
            net[name][at] = was - eps
            slope = (up - loss()) / (2 * eps)
            net[name][at] = was
            assert abs(slope) < 2e-3 or np.sign(slope) == -np.sign(stepped[name][at] - was)


def test_parts_of_a_stream_score_as_the_whole():
    rng = np.random.default_rng(5)
    net = language_model.start(rng.integers(1, 50, language_model.PAD).astype(float))
    docs = [rng.integers(0, language_model.PAD, n) for n in (0, 1, 30, 3, 200)]
    whole = language_model.log_chances(net, language_model.stream(docs))
    cut = np.concatenate([language_model.log_chances(net, p) for p in language_model.steps(language_model.stream(docs), 7)])
    assert len(whole) == 234 and np.allclose(whole, cut, atol=1e-5)
    alone = np.concatenate([language_model.log_chances(net, language_model.stream([d])) for d in docs])
    assert np.allclose(whole, alone, atol=1e-5)


def test_masked_lm_puts_junk_last(spark):
    """Nonsense below the least twentieth of a corpus, shuffled texts below the same ones in order."""
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    some = [r["text"].split() for r in docs.where("length(text) > 2000").orderBy("doc_id").limit(40).collect()]
    nonsense = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(200))
    extra = [(-1, nonsense), *((-2 - i, " ".join(rng.sample(w, len(w)))) for i, w in enumerate(some)), *((-102 - i, " ".join(w)) for i, w in enumerate(some))]
    got = {r["doc_id"]: r for r in language_model.score(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    known = sorted(r["mean_log_likelihood"] for d, r in got.items() if d >= 0 and r["n_tokens"] > 20)
    assert got[-1]["mean_log_likelihood"] < known[len(known) // 20]
    assert sum(got[-2 - i]["mean_log_likelihood"] < got[-102 - i]["mean_log_likelihood"] for i in range(len(some))) >= 38


def test_masked_lm_predicts_every_word(spark):
    """Of two texts that differ in one word outside the vocabulary, with the same ending, the one with the commoner word scores higher by the ratio of counts."""
    rng = random.Random(1)
    known = [f"w{i}" for i in range(language_model.VOCABULARY)]
    texts = [" ".join(known * 5)] + ["rarexx"] * 3 + ["oncexx"] + [" ".join(rng.choice(known) for _ in range(50)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in language_model.score(frame).collect()}
    assert got[1]["log_likelihood"] - got[4]["log_likelihood"] == pytest.approx(np.log(3), abs=1e-4)
    assert got[1]["n_tokens"] == got[4]["n_tokens"] == 1


def test_masked_lm_trains_on_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_model, "_averaged", lambda copies, net: seen.append(sum(r["n"] for r in copies.collect())) or net)
    texts = [f"a b c d{i}" for i in range(90)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert language_model.score(frame).count() == 92
    assert seen == [4 * 90] * language_model.ROUNDS


def test_licences_across_lines_and_in_prose(spark):
    import textwrap

    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and "NONINFRINGEMENT" in t)
    apache = next(t for n, t in licences.TEMPLATES if n == "Apache-2.0" and "AS IS" in t)
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(apache, 60))
    texts = [
        "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(mit, 80),
        f"/*\n * Copyright 2020 Somebody\n{wrapped}\n */\nint main() {{ return 0; }}\n" + "more text here " * 200,
        "some words before it. This work is licensed under the GNU General Public License, version 3. And words after it " * 2,
        "the software and the rights to use of the work " * 100,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["n_passages"]) for r in licences.scan(frame).collect()}
    assert got == {(0, "MIT"): (1.0, 1), (1, "Apache-2.0"): (1.0, 1), (2, "GPL-3.0"): (1.0, 2)}


def test_line_dedup_tells_repeated_ids_apart(spark):
    rows = [(0, "a\nb\nc"), (1, "p\na\nb\nc"), (1, "q\nr\ns\nt\nu"), (1, "v\nw"), (2, "p\na\nb\nc")]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, done)) == [(0, "a\nb\nc"), (1, "p"), (1, "q\nr\ns\nt\nu"), (1, "v\nw"), (2, "")]


def two_views(n, rng):
    """Documents whose words and whose source each tell the class, on their own, most of the time."""
    rows = []
    for i in range(n):
        y = rng.random() < 0.5
        words = [f"{'g' if y == (rng.random() < 0.6) else 'b'}{rng.randrange(150)}" for _ in range(30)]
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(4) + (0 if y == (rng.random() < 0.99) else 4)}", 100, int(y)))
    return rows


def test_views_share_no_input(spark):
    rows = two_views(400, random.Random(3))
    frame = lambda rows: spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:200]], "doc_id long, quality int")
    good, bad = (" ".join(f"{k}{rows[0][0] + 5 * i}" for i in range(30)) for k in "gb")
    extra = [(1000, good, "en", "s1", 100, 0), (1001, bad, "en", "s1", 100, 0), (1002, good, None, None, None, 0)]
    got = {r["doc_id"]: r for r in cotraining.classify(frame(rows + extra), labels).collect()}
    assert got[1000]["p_meta"] == got[1001]["p_meta"] and got[1000]["p_content"] != got[1001]["p_content"]
    assert got[1000]["p_content"] == got[1002]["p_content"]


def test_exchange_helps_where_labels_are_few(spark):
    rows = two_views(3000, random.Random(5))
    frame = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:250]], "doc_id long, quality int")
    truth = {r[0]: r[5] for r in rows[250:]}

    def right(rounds):
        got = cotraining.classify(frame, labels, rounds=rounds).where("doc_id >= 250").collect()
        return sum((r["p_content"] >= 0.5) == truth[r["doc_id"]] for r in got) / len(truth)

    assert right(3) > right(0) + 0.02


def test_surest_are_those_of_a_plain_sort(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(500, 4)).astype("<f4"), rng.normal(size=(500, 3)).astype("<f4")
    y = (x[:, 0] + z[:, 0] > 0).astype(float)
    models = {"content": cotraining._fitted(x, y, x, y), "meta": cotraining._fitted(z, y, z, y)}
    frame = spark.createDataFrame([(i, a.tobytes(), b.tobytes()) for i, (a, b) in enumerate(zip(x, z, strict=True))], "doc_id long, content binary, meta binary").repartition(5)
    taken = set(range(0, 500, 7))
    found = cotraining._surest(frame, models, 20, 0.7, taken).collect()
    p = {"meta": np.round(models["content"].chance(x), 6), "content": np.round(models["meta"].chance(z), 6)}
    for to, value, n in cotraining._lists(20, 0.7):
        plain = sorted((abs(value - p[to][i]), i) for i in range(500) if i not in taken and abs(value - p[to][i]) <= 1 - cotraining.CONFIDENT)[:n]
        mine = sorted((r["doubt"], r["doc_id"], r["x"]) for r in found if r["to"] == to and r["value"] == value)[:n]
        assert [(round(d, 6), i) for d, i, _ in mine] == [(round(d, 6), i) for d, i in plain]
        assert all(b == (x if to == "content" else z)[i].tobytes() for _, i, b in mine)


def test_sums_of_groups():
    """Groups of one row and of hundreds, in any order, against numpy's own sums."""
    rng = np.random.default_rng(3)
    tokens = np.concatenate([np.repeat(np.arange(40), np.arange(1, 41) ** 2 % 90 + 1), [77]])
    rng.shuffle(tokens)
    rows = rng.integers(-9, 9, (len(tokens), 6)).astype(np.float32)
    by = np.argsort(tokens, kind="stable")
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(tokens[by])) + 1])
    for n in (len(by), 1):
        f = firsts[firsts < n]
        assert (language_model._group_sums(rows, by[:n], f) == np.add.reduceat(rows[by[:n]], f)).all()


def test_ranks_tell_exactly_the_first_200_bytes():
    """Windows that agree in 128 bytes, in 199 and in 200; zero bytes and the end of the data."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 260, dtype=np.uint8)
    other = [np.concatenate([base[:n], base[n:] ^ 1]) for n in (128, 199, 200, 201)]
    for data in (np.concatenate([base, *other, np.zeros(207, dtype=np.uint8)]), rng.integers(0, 2, 900, dtype=np.uint8) // 2):
        order, rank = suffix_dedup.suffix_array(data, 200)
        windows = [data[i : i + 200].tobytes() for i in range(len(data) - 199)]
        assert sorted(order.tolist()) == list(range(len(data)))
        assert [windows[i] for i in order if i < len(windows)] == sorted(windows)
        assert len(set(zip(rank.tolist(), windows, strict=False))) == len(set(windows)) == len(set(rank[: len(windows)].tolist()))


def test_workers_give_back_what_a_task_freed():
    """Small arrays go to the heap, and one that outlives them at its end keeps it from shrinking by itself."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    kept = []

    def over(batches):
        for batch in batches:
            held = [np.ones(50_000, dtype=np.uint8) for _ in range(4000)]
            kept.append(np.ones(50_000, dtype=np.uint8))
            yield batch
            del held

    before = resident()
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.lean(over)(iter([batch, batch]))) == [batch, batch]
    assert resident() - before < 60
