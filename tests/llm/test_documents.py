"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from baleprice.llm import imatch, jaccard, licences, mixing, pack, substrings, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["_id", "_key", "at", "bucket", "component", "found", "head", "key", "label", "n", "node", "score", "size", "_n", "u", "v"]


def _words(rng, n, vocabulary=60):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    shared = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = _words(rng, rng.choice([0, 1, 3, 5, 12, 13, 14, 30, 120]), 4000)
        if i % 4 == 0:
            words = words[:5] + shared[:rng.choice([12, 13, 60])] + words[5:]
        rows.append(words)
    base = _words(rng, 100, 4000)
    for i in range(20):  # near copies, chained
        base = list(base)
        base[rng.randrange(100)] = f"edit{i}"
        rows.append(base)
    rows += [rows[3], rows[74], [w.upper() for w in rows[75]], ["x"] * 40, ["x"] * 13, ["solo"], ["SOLO"]]
    texts = [rng.choice([" ", "\n", " \t"]).join(r) for r in rows] + [None, "", "  \n ", "é " * 30000 + "end", "one\x0btwo\x1cthree"]
    return [(3 * i - 40, t, "en", rng.choice(["b", "a", "ä", None]), 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), DDL)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.repartition(5, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_without_repeats_keeps_other_columns(spark, docs, none):
    parsed = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    cut = substrings.without_repeats(docs)
    assert cut.schema.names == docs.schema.names and cut.dtypes == docs.dtypes
    before = {r.doc_id: r for r in docs.collect()}
    want = {}
    for i, r in before.items():
        if not parsed[i].n_removed:
            want[i] = r
        elif parsed[i].kept:
            want[i] = tuple(parsed[i].kept if c == "text" else r[c] for c in docs.columns)
    got = cut.collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r) for r in got} == {i: tuple(r) for i, r in want.items()}
    assert 0 < sum(p.n_removed > 0 for p in parsed.values()) and len(want) < len(before)
    assert substrings.without_repeats(none).count() == 0
    run = " ".join(f"z{i}" for i in range(20))
    rows = spark.createDataFrame([(1, run, "a"), (2, run + " end", "b"), (2, "short", "c"), (None, run, "d")],
                                 "doc_id long, text string, `x.y` string")
    assert sorted((r.doc_id or 0, r.text, r["x.y"]) for r in substrings.without_repeats(rows).collect()) == [
        (0, run, "d"), (1, run, "a"), (2, "end", "b"), (2, "short", "c")]


def test_substrings(docs, none):
    rows = {i: split(t) for i, t, *_ in corpus()}
    starts = defaultdict(set)
    for i, w in rows.items():
        for j in range(len(w) - 12):
            starts[tuple(w[j:j + 13])].add(i)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert got.keys() == rows.keys()
    removed = 0
    for i, w in rows.items():
        gone = {k for j in range(len(w) - 12) if min(starts[tuple(w[j:j + 13])]) < i for k in range(j, j + 13)}
        removed += len(gone)
        assert got[i].n_words == len(w) and got[i].n_removed == len(gone)
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert {k for s in got[i].spans for k in range(s.start, s.start + s.length)} == gone
    assert removed > 100
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_null_and_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = substrings.remove_repeats(spark.createDataFrame(
        [(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 20)]


def _sets():
    out = {}
    for i, t, *_ in corpus():
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def _components(sets):
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_components(docs, none):
    sets = _sets()
    want = _components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 15
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_null_ids_stay(spark):
    """Rows with a null id stay, a row each, with their set's size, and link with nothing."""
    text = " ".join(f"a{i}" for i in range(30))
    rows = spark.createDataFrame([(None, text), (None, text), (None, None), (4, text), (7, text), (7, "b"), (9, None)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(rows).collect())
    assert got == [(0, 0, 0), (0, 26, 0), (0, 26, 0), (4, 26, 4), (7, 26, 4), (9, 0, 9)]


@pytest.mark.parametrize("group", [2000, 3])
def test_jaccard_matrix_alone_finds_all_links(spark, monkeypatch, group):
    """Without any leader found before, the matrix still loses no link, also where its groups are dealt to many."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = random.Random(9)
    base = _words(rng, 80, 3000)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(80)] = f"e{rng.randrange(2000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_grouped_links", lambda sets, percent, lows: sets.selectExpr("doc_id AS u", "doc_id AS v").limit(0))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(76)} for i, t in rows}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == _components(sets)


def test_mix(docs, none):
    got = {r.doc_id: r for r in mixing.mix(docs, rows_per_range=7).collect()}
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(3), rows_per_range=1000).collect()}
    assert got == again
    sizes = defaultdict(int)
    for i, t, _, s, _ in corpus():
        assert got[i].size == len(split(t))
        sizes[s] += got[i].size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    taken = defaultdict(int)
    for r in got.values():
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1.0001 for s in order)
    assert mixing.mix(none).count() == 0


def test_mixed_documents(docs):
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    rows = defaultdict(list)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        rows[r.doc_id].append(split(r.text))
    text = {i: split(t) for i, t, *_ in corpus()}
    for i, r in taken.items():
        assert sum(map(len, rows[i])) == r.taken and all(x == text[i][:len(x)] for x in rows[i])
        assert len(rows[i]) == (-(-r.taken // r.size) if r.size else 1)


def test_mixed_documents_null_and_repeated_ids(spark):
    """Every row stands for itself, told apart by its lang here: all words of a source sum to its target."""
    rng = random.Random(13)
    rows = [(rng.choice([None, 7, 7, i]), " ".join(f"r{i}w{k}" for k in range(rng.choice([0, 3, 3, 20]))) or None, f"row{i}",
             rng.choice(["a", "b", None]), 0) for i in range(90)]
    rows += [(5, "same text here", "copy", "a", 0)] * 3
    df = spark.createDataFrame(rows, DDL)
    targets = {(r.source): int(r.target) for r in mixing.mix(df).collect()}
    got = [tuple(r) for r in mixing.mixed_documents(df, rows_per_range=20).collect()]
    assert sorted(map(str, got)) == sorted(map(str, map(tuple, mixing.mixed_documents(df.repartition(3)).collect())))
    by_row, words = defaultdict(list), defaultdict(int)
    for i, text, lang, source, n in got:
        by_row[lang].append((i, split(text), source))
        words[source] += len(split(text))
    assert words == targets
    whole = {r[2]: (r[0], split(r[1]), r[3]) for r in rows}
    for lang, held in by_row.items():
        i, text, source = whole[lang]
        assert len(held) <= (6 if lang == "copy" else 2)
        assert all(h[0] == i and h[2] == source and h[1] == text[:len(h[1])] for h in held)
        if lang != "copy":
            assert sum(len(h[1]) < len(text) for h in held) <= 1
    assert all(len(by_row[lang]) == 1 for lang, (_, text, _) in whole.items() if not text)
    assert {None, 7} <= {g[0] for g in got}


def test_best_fit_by_hand():
    assert pack.best_fit([], (4, 8)) == []
    # 5 opens an 8, 3 fills it; 2 and 1 share a bin that shrinks to 4
    assert pack.best_fit([5, 3, 2, 1], (4, 8), 1) == [(0, 0, 8), (0, 5, 8), (1, 0, 4), (1, 2, 4)]
    # the piece goes where the least room is left
    assert [b for b, _, _ in pack.best_fit([6, 5, 3, 2], (8,), 0)] == [0, 1, 1, 0]


def test_opening_length_looks_over_the_whole_fill():
    def by_hand(sizes, first):
        rates = []
        for length in pack.LENGTHS:
            room = length
            for size in sizes[first:]:
                room -= size if size <= room else 0
            rates.append(((length + 16) / (length - room), length) if room < length else (float("inf"), length))
        return min(rates)[1]

    assert [pack.opening_length([n] * 9000, 0, pack.LENGTHS, 16) for n in (1, 20, 50)] == [8192] * 3
    rng = random.Random(11)
    for top in (3, 60, 700, 9000):
        sizes = sorted((min(8192, rng.randint(1, top)) for _ in range(rng.choice([5, 300, 3000]))), reverse=True)
        assert all(pack.opening_length(sizes, i, pack.LENGTHS, 16) == by_hand(sizes, i) for i in range(0, len(sizes), 37))


def test_many_tiny_pieces_fill_long_bins():
    rng = random.Random(12)
    sizes = sorted((rng.randint(3, 60) for _ in range(50_000)), reverse=True)
    bins = {b: length for b, _, length in pack.best_fit(sizes)}
    assert len(bins) <= 1.02 * sum(sizes) / 8192 and sum(bins.values()) - sum(sizes) < 8192


def test_pack(docs, none):
    lengths = (16, 64, 256)
    rows = pack.pack(docs, lengths=lengths, pieces_per_group=40).collect()
    again = pack.pack(docs.repartition(2), lengths=lengths, pieces_per_group=40).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.n_tokens))
        if r.n_tokens:
            bins[r.bin].append(r)
        else:
            assert r.bin is None and r.bin_length is None
    for i, t, *_ in corpus():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at) and n <= 256
            at += n
        assert at == len(split(t))
    for held in bins.values():
        used = sum(r.n_tokens for r in held)
        assert {r.bin_tokens for r in held} == {used}
        assert {r.bin_length for r in held} == {min(x for x in lengths if x >= used)}
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
    assert sum(r.n_tokens for r in rows) >= 0.97 * sum(h[0].bin_length for h in bins.values())
    assert pack.pack(none).count() == 0


def test_imatch(docs, none):
    terms = imatch.lexicon(docs, idf_band=(0.1, 20))
    got = {r.doc_id: r for r in imatch.imatch(docs, terms=terms).collect()}
    texts = {i: t or "" for i, t, *_ in corpus()}
    assert got.keys() == texts.keys()
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i].fingerprint)
        assert any(re.split(imatch.BREAKS, t.lower())) or set(got[i].fingerprint) == {"-"}
        assert len(got[i].fingerprint) == 16 * len(imatch.SUBSETS)
    assert all(len(p) == 1 for p in by_text.values())
    assert imatch.imatch(none).count() == 0


def test_imatch_subsets_by_brute_force(spark):
    """Order, case and repeats of terms don't matter; a term outside the band changes nothing."""
    texts = ["alpha beta gamma", "gamma, ALPHA beta beta", "alpha beta gamma rare", "alpha beta delta", "delta gamma", "gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = imatch.lexicon(df, idf_band=(0.0, 1.2))  # in two documents or more
    prints = imatch.imatch(df, terms=terms)
    p = {r.doc_id: r.prints for r in prints.collect()}
    assert p[0] == p[1] == p[2] and p[0][0] != p[3][0] and len({p[i][0] for i in (0, 3, 4, 5)}) == 4
    near = prints.filter("doc_id = 0").select(F.col("prints").alias("a")).crossJoin(
        prints.filter("doc_id = 3").select(F.col("prints").alias("b"))).select(
            imatch.likeness(F.col("a"), F.col("b"))).first()[0]
    held = [(x, y) for x, y in zip(p[0], p[3]) if x is not None or y is not None]
    assert near == sum(x == y for x, y in held) / len(held)


def test_imatch_band_is_of_terms(spark):
    """With far more terms than the 2**18 ids of a hashed vocabulary would tell apart, a rare term changes no fingerprint."""
    common = [" ".join(f"c{(7 * i + j) % 40}" for j in range(10)) for i in range(60)]
    rare = [" ".join(f"r{i}x{j}" for j in range(6000)) for i in range(60)]
    ddl = "doc_id long, text string"
    df = spark.createDataFrame([(i, f"{c} {r}") for i, (c, r) in enumerate(zip(common, rare))], ddl)
    terms = imatch.lexicon(df, idf_band=(0.5, 3.0))
    assert terms.count() == 40
    bare = {r.doc_id: r.fingerprint for r in imatch.imatch(spark.createDataFrame(list(enumerate(common)), ddl), terms=terms).collect()}
    assert bare == {r.doc_id: r.fingerprint for r in imatch.imatch(df, terms=terms).collect()}


def test_imatch_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, None, 3), (3, "c", 4)], "term long, held string, place int")
    got = imatch.imatch(df, "term", "held", (0.0, 1.0)).collect()
    assert sorted((r.term is None, set(r.fingerprint) == {"-"}) for r in got) == [(False, False), (False, True), (True, False), (True, False)]
    assert len({r.fingerprint for r in got if r.term is None}) == 1


def test_licences(spark, none):
    mit = "\n".join(["The MIT License", "", *[licences.SENTENCES[f"mit-{x}"].replace("to deal in", "to deal\n in")
                                             for x in ("grant", "notice", "warranty")]])
    bsd = licences.SENTENCES["bsd-grant"] + " 1. Keep the notice. " + licences.SENTENCES["bsd-endorse"]
    texts = {
        1: "Zu und. Der\nLicensed under the Apache License, Version 2.0.", 2: "released  UNDER the mit license.\nfoo", 3: mit,
        4: bsd, 5: licences.SENTENCES["bsd-grant"], 6: None, 7: "", 8: "a " * 200000 + "\nLicensed under CC BY-NC 4.0.",
        9: "We say: not Licensed under the MIT License, ever.",
        10: " ".join(licences.SENTENCES[f"mit-{x}"] for x in ("warranty", "notice", "grant")),
        11: f"Licensed under CC BY 4.0. Or this. {licences.SENTENCES['gpl-3.0-work']}"}
    df = spark.createDataFrame([*texts.items(), (None, "Licensed under CC0 1.0.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert {i: r.licences for i, r in got.items()} == {
        1: ["Apache-2.0"], 2: ["MIT"], 3: ["MIT"], 4: ["BSD-3-Clause"], 5: ["BSD-2-Clause"], 6: [], 7: [],
        8: ["CC-BY-NC-4.0"], 9: [], 10: [], 11: ["CC-BY-4.0", "GPL-3.0-only"], None: ["CC0-1.0"]}
    assert got[10].sentences == ["mit-warranty", "mit-notice", "mit-grant"]
    assert licences.scan(none).count() == 0


def test_licence_sentences_hold_no_stop():
    for text in licences.SENTENCES.values():
        assert len([p for p in re.split(licences._STOP, text) if licences.normalised(p)]) == 1, text


def _toxic_rows(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        toxic = rng.random() < 0.3
        words = _words(rng, rng.randrange(5, 60), 500) + ["vile"] * toxic
        rng.shuffle(words)
        yield i, " ".join(words), int(toxic)


def test_toxicity(spark, none):
    rows = list(_toxic_rows(900, 1))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(1, 1, None), (7777, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert len(held) > 150 and sum(p == t for p, t in held) >= 0.98 * len(held)
    assert got[5000].score == got[5001].score
    # held-out labels change nothing
    flipped = labels.filter(~toxicity.held_out()).unionByName(
        labels.filter(toxicity.held_out()).selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    kept = toxicity.without_toxic(docs.selectExpr("*", "'x' AS score", "1 AS at"), toxicity.fit(
        toxicity.learning_rows(docs, labels)))
    assert kept.columns == ["doc_id", "text", "score", "at"]
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxicity(none, labels).count() == 0
    unlearned = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlearned} == {(0.0, 0)}


def test_toxicity_bounds_a_workers_memory(spark):
    """Features and scores of a large batch are made from little text at a time, and batches come small."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    rng = random.Random(4)
    texts = [" ".join(_words(rng, 2000, 500)) for _ in range(40)] * 20
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "at": list(range(len(texts))),
                                        "label": [0] * len(texts), "text": texts})
    size = sum(map(len, texts))
    assert size > 6 << 20
    model = np.arange(0, 1 << 20, 3, dtype=np.int32), np.ones(349526, np.float32), -1.0
    for run in (toxicity._scores(model), toxicity._vectors):
        tracemalloc.start()
        assert sum(out.num_rows for out in run([batch])) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 110 << 20, peak >> 20
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    toxicity.score(other.createDataFrame([(1, "a")], "doc_id long, text string"), None)
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


def test_learned_rows_are_views_of_their_batch():
    import numpy as np
    import pyarrow as pa
    lists = [[1, 2], [], [3], [], [7, 8, 9]]
    column = pa.array([np.array(x, np.int32).tobytes() for x in lists], pa.binary())
    assert [x.tolist() for x in toxicity._rows_of(column)] == lists
    assert [x.tolist() for x in toxicity._rows_of(column.slice(1, 3))] == lists[1:4]
    assert [x.tolist() for x in toxicity._rows_of(column.slice(1, 1))] == [[]]


def test_ftrl_by_hand():
    import numpy as np
    w, bias = toxicity.ftrl([np.array([3]), np.array([4])] * 30, [1, 0] * 30, epochs=1, alpha=0.5, l1=0.1, l2=0.0)
    assert w[3] > 0 > w[4] and np.count_nonzero(w) == 2 and abs(bias) < 1
    assert np.count_nonzero(toxicity.ftrl([np.array([3])] * 5, [1] * 5, l1=100.0)[0]) == 0


def test_sha_of_kept(spark):
    df = spark.createDataFrame([(1, "a  b\n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in substrings.with_digest(substrings.remove_repeats(df)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_one_per_component_keeps_the_texts_of_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (3, b), (4, a), (None, a), (5, None), (6, ""), (7, "other words of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_hash", "'y' AS least")
    kept = [(r.doc_id, r.text) for r in jaccard.one_per_component(df).collect()]
    assert {t for _, t in kept} == {a, b, None, "", "other words of its own here"}
    assert sorted(i for i, _ in kept if i == 1) == [1, 1] and (None, a) in kept and len(kept) == len(set(kept))


def test_components_of_stars_chains_and_rings(spark):
    from baleprice.llm.common import components
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3), (9, None)] + [(0, 1)] * 5
    links = spark.createDataFrame(edges, "u long, v long")
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for u, v in edges:
            if None not in (u, v) and u != v:
                label[u] = label[v] = min(label[u], label[v])
    for one_task in (0, 1 << 20):  # by star contraction, and ended in one task
        found = components(links.repartition(4), one_task=one_task).collect()
        assert len(found) == len(label) and {r.node: r.component for r in found} == label
    assert components(links.limit(0)).collect() == components(links.limit(0), one_task=-1).collect() == []


def test_forest_in_pieces(monkeypatch):
    """A partition with more links than a piece keeps what its links connect."""
    import numpy as np
    import pyarrow as pa

    from baleprice.llm import common
    monkeypatch.setattr(common, "_FOREST", 50)
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 400, 900), rng.integers(0, 400, 900)
    batches = [pa.RecordBatch.from_pydict({"u": u[i:i + 30], "v": v[i:i + 30]}) for i in range(0, 900, 30)]
    out = list(common._forest(False)(iter(batches)))
    assert len(out) > 1 and sum(b.num_rows for b in out) < 900
    left = common._least_linked(np.concatenate([b["u"].to_numpy() for b in out]), np.concatenate([b["v"].to_numpy() for b in out]))
    nodes, least = common._least_linked(u, v)
    want = {n: m for n, m in zip(nodes, least) if (least == m).sum() > 1}
    assert {n: m for n, m in zip(*left)} == want


def test_imatch_query_against_brute_force(spark, tmp_path):
    """Edited texts, fingerprints and both likenesses; null ids, repeated ids and equal rows keep a row each."""
    import math

    import xxhash

    from baleprice.llm.queries import op4_imatch_fingerprints

    rng = random.Random(12)
    rows = [(i, " ".join(_words(rng, rng.choice([1, 8, 40, 90]), 400))) for i in range(60)]
    rows += [(None, "lost und found"), (None, None), (70, ""), (71, "!?"), (72, "\u00e9 \U0001F600 w1 w2 w3"),
             (73, "onlyhere nowhereelse"), (5, rows[5][1]), (5, "other w1 text of five")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op4_imatch_fingerprints(spark, str(tmp_path)).collect()]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hash_all(values):
        seed = 42
        for x in values:
            seed = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
        return seed

    def ids(text):
        terms = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
        return {signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in terms}

    counts = defaultdict(int)
    for _, t in rows:
        for i in ids(t):
            counts[i] += 1
    band = {i for i, c in counts.items() if len(rows) / math.exp(6) <= c <= len(rows) / math.exp(3)}

    def prints(text):
        of = sorted(ids(text) & band)
        if ids(text) and not of:
            return [hash_all(sorted(ids(text)))] + [None] * (len(imatch.SUBSETS) - 1)
        parts = [[h for h in of if not h & ((1 << level) - 1) << (16 * r)] for level, r in imatch.SUBSETS]
        return [hash_all(p) if p else None for p in parts]

    def as_text(hashes):
        return "".join("-" * 16 if h is None else f"{h:016x}" for h in hashes)

    def likeness(a, b):
        held = [(x, y) for x, y in zip(a, b) if (x, y) != (None, None)]
        return sum(x == y for x, y in held) / len(held) if held else 1.0

    placed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = []
    for k, (i, t) in enumerate(placed):
        t, following = t or "", placed[(k + 1) % len(placed)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(prints(t)), as_text(prints(edited)),
                     likeness(prints(t), prints(edited)), likeness(prints(t), prints(following))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert len(got) == len(rows) and sorted(got, key=key) == sorted(want, key=key)
    assert any(w[3].strip("-") and not w[3][16:].strip("-") for w in want)
