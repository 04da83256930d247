from collections import defaultdict

import pytest

from tests.llm.test_corpus import WORD, corpus, shingles, table, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from trajectra.llm import mixing, pii, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == docs.columns
        seen.append(out.count())
        docs = out
    assert seen[0] >= seen[1] > seen[2] >= seen[3] == seen[4]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert 0 < mixed.count() <= seen[4]


def kept(rows):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in rows)


def test_near_duplicates_by_plain_comparison(spark):
    rows = corpus() + [(70, " ".join(words(80, 70)), "en", "s"), (70, " ".join(words(80, 71)), "en", "s"), (None, " ".join(words(80, 72)), "en", "s"), (None, " ".join([*words(80, 72), "more"]), "en", "s"), (None, " ".join(words(80, 73)), "en", "s")]
    sets = [shingles(t, 5) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), FOLDER)
    assert got.columns == table(spark, rows).columns
    out = kept(got.collect())
    assert len(out) == len(groups)
    for members in groups.values():
        least = min((m[0] is None, m[0] or 0) for m in members)
        assert sum((str(d), str(t)) in out for d, t in {(m[0], m[1]) for m in members}) == 1
        assert any((str(m[0]), str(m[1])) in out for m in members if (m[0] is None, m[0] or 0) == least)


def test_the_other_stages_by_plain_rules(spark):
    """What each stage keeps, told from the model's scores, the leaks, the spans and the sizes one row at a time."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    scores = model.scores([r["text"] or "" for r in rows])
    assert kept(corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()) == kept(r for r, s in zip(rows, scores) if s < 0.7)

    items = [[w.lower() for w in WORD.findall(r["text"] or "")] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def bag(w, k):
        out = defaultdict(int)
        for i in range(len(w) - k + 1):
            out[" ".join(w[i : i + k])] += len(" ".join(w[i : i + k]))
        return out

    def leaks(text):
        own = [w.lower() for w in WORD.findall(text or "")]
        for item in filter(None, items):
            k = min(5, len(item))
            there, grams = bag(item, k), bag(own, k)
            if sum(v for s, v in there.items() if s in grams) < 0.5 * sum(there.values()):
                continue
            for start in range(len(own) - k + 1):
                window = bag(own[start : start + len(item)], k)
                common = sum(min(n, there[s]) for s, n in window.items() if s in there)
                if common / (sum(window.values()) + sum(there.values()) - common) >= 0.8:
                    return True
        return False

    assert kept(corpus_pipeline.drop_leaks(spark, docs, FOLDER).collect()) == kept(r for r in rows if not leaks(r["text"]))

    tagger = pii._fitted(docs, pii.SAMPLE)
    want = []
    for r, (base, spans) in zip(rows, pii.spans_of(tagger, [r["text"] or "" for r in rows])):
        text = r["text"] or ""
        for start, kind, end in sorted(spans, reverse=True):
            text = text[:start] + f"[{pii.KINDS[kind].upper()}]" + text[end:]
        want.append((str(r["doc_id"]), text))
    got = corpus_pipeline.mask_personal_data(spark, docs, FOLDER).collect()
    plain = {d: t for d, t in want}
    assert sum(plain[str(r["doc_id"])] != r["text"] for r in got if r["text"] is not None) <= 0.01 * len(got)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)

    mixed = {r["doc_id"]: r for r in corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.quotas(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(names)})
    taken = defaultdict(int)
    for r in rows:
        if r["doc_id"] in mixed:
            assert mixed[r["doc_id"]]["size"] == len(WORD.findall(r["text"] or "")) and mixed[r["doc_id"]]["taken"] == mixed[r["doc_id"]]["size"] * mixed[r["doc_id"]]["repeats"]
            taken[r["source"]] += mixed[r["doc_id"]]["taken"]
    for s in names:  # what is left open is less than any document that could be taken once more
        times = {r["doc_id"]: mixed[r["doc_id"]]["repeats"] if r["doc_id"] in mixed else 0 for r in rows if r["source"] == s and WORD.search(r["text"] or "")}
        free = [len(WORD.findall(r["text"])) for r in rows if r["doc_id"] in times and times[r["doc_id"]] == min(times.values())]
        assert 0 <= round(target[s]) - taken[s] < max(1, min(free, default=1), 0.01 * target[s])


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
