"""Terms that disclose personal data: against brute force, on planted names, and where kinds are frequent."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import pii

WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def lowered(w):
    return re.sub("[A-Z]", lambda m: m[0].lower(), w)


def naive_disclosing(texts):
    """{(kind or None, term)} from the definitions alone."""
    n, with_e, with_te, with_t = len(texts), defaultdict(list), defaultdict(list), Counter()
    for t in texts:
        spans = pii.base_spans(t or "")
        words = [(lowered(m[0]), *m.span()) for m in WORD.finditer(t or "")]
        with_t.update({w for w, _, _ in words})
        seen = set()
        for kind, a, b in spans:
            value = t[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", t[a:b])
            near = [x for x in words if x[2] <= a][-pii.WINDOW :] + [x for x in words if x[1] >= b][: pii.WINDOW]
            free = [w for w, x, y in near if y - x > 2 and not any(x < d and c < y for _, c, d in spans)]
            seen |= {((kind, value), w) for w in (None, *free)} | {((kind, None), w) for w in (None, *free)}
        for e, w in seen:
            (with_e[e] if w is None else with_te[e, w]).append(t)
    out = set()
    for (e, w), docs in with_te.items():
        if len(set(docs)) < 2 or len(set(with_e[e])) < 2:
            continue
        n_te, n_e, n_t = len(docs), len(with_e[e]), with_t[w]
        pmi, chance = math.log(n * n_te / (n_t * n_e)), n_t * n_e / n
        if pmi >= math.log(n / n_e) / pii.ALPHA and n_te * pmi - (n_te - chance) >= pii.SURE and (e[1] is not None or n_e <= pii.MOST_COMMON * n):
            out.add((None if e[1] is not None else e[0], w))
    return out


def corpus(seed, n=600):
    rng = np.random.default_rng(seed)
    common, rare = [f"word{c}" for c in "abcdefghij"] + ["the", "and", "went"], [f"rare{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    texts = [" ".join(rng.choice([*common, *common, *common, *rare], rng.integers(5, 60))) for _ in range(n)]
    names = []
    for i in range(24):
        name, mail = f"Person{'abcdefghijklmnopqrstuvwx'[i]}", f"p{i}@mail.example"
        names.append(name)
        for k in rng.choice(n, int(rng.integers(3, 7)), replace=False):
            words = texts[k].split()
            at = int(rng.integers(0, len(words)))
            texts[k] = " ".join([*words[:at], name, "writes", mail, *words[at:]])
            if rng.random() < 0.5:
                texts[k] += f" signed {name}"
    return texts, names


def test_disclosing_terms_equal_brute_force(spark):
    for seed in (1, 2):
        texts, _ = corpus(seed)
        texts += texts[:50] + [None, "", "10.0.0.1 é@x.yy"]
        got = {(r["kind"], r["term"]) for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
        hashes = {lowered(t[a:b]): h for t in texts if t for a, b, h in zip(*pii._words(t), strict=True)}
        assert got == {(k, int(hashes[w])) for k, w in naive_disclosing(texts)}


@pytest.mark.parametrize("most", [pii.BROADCAST_HASHES, 0])
def test_planted_names_go_and_other_words_stay(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_HASHES", most)
    texts, names = corpus(3)
    rows = [(i, t, i, "k", "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long, key string, pairs string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    left = Counter(w for r in got.values() for w in WORD.findall(r["text"]))
    # recall: no planted name is left; precision: no other word is ever taken but "writes" and "signed", which stand beside addresses alone
    assert not any(left[x] for x in names)
    before = Counter(w for t in texts for w in WORD.findall(re.sub(r"p\d+@mail.example", "", t)))
    changed = {w for w in before if left[w] != before[w]} - set(names)
    assert changed <= {"writes", "signed"}, changed
    clean = [i for i, t in enumerate(texts) if "@" not in t]
    assert len(clean) > 300 and all(got[i]["text"] == texts[i] for i in clean)
    assert all(got[i]["__key"] == i and got[i]["key"] == "k" and got[i]["pairs"] == "p" for i in got)


def test_a_frequent_kind_destroys_no_text(spark):
    rng = np.random.default_rng(4)
    words = ["the", "report", "and", "went", "over", "hill", "again", "with", "all"]
    texts = [" ".join(x for k in range(60) for x in (*rng.choice(words, 5), f"u{i}x{k}@mail.example")) for i in range(10)] + [" ".join(rng.choice(words, 80)) for _ in range(20)]
    for copies in (1, 40):
        rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts * copies)), "doc_id long, text string")).collect()
        assert sum(r["n_term"] for r in rows) == 0 and all("[EMAIL]" in r["text"] for r in rows if r["doc_id"] % 30 < 10)


def test_only_terms_that_may_disclose_are_counted_and_once_a_task(spark, monkeypatch, tmp_path):
    real = pii.releasing

    def counting(task):
        whole = real(task)
        if task.__name__ != "df":
            return whole

        def run(batches):
            for batch in whole(batches):
                with open(tmp_path / "rows", "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return run

    monkeypatch.setattr(pii, "releasing", counting)
    texts, names = corpus(5, 3000)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r["term"] for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {pii._words(x)[2].tolist()[0] for x in names} <= found
    # common words stand beside addresses too, but cannot disclose one; names, the hundred rare words and a few more remain, each told once by each of four tasks
    rows = sum(map(int, (tmp_path / "rows").read_text().split()))
    assert rows <= 4 * (len(names) + 110), rows
