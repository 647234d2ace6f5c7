import numpy as np

from lexloom.llm import scans as S
from lexloom.llm.scans import candidates, paragraphs

HEADS = ["Relay Storage Act 1975", "RELAY STORAGE ACT 1975"]


def results():
    """Texts without pages: heads recur, but only some break into a sentence, so the seeds leave the others open."""
    out = []
    for k in range(60):
        lines = []
        for page in range(4):
            who = ["licensed", "foreign", "former", "public"][page]
            body = [f"The {who} carrier must keep the register of permits in the territory of", f"the {who} state and the office may exempt it.", f"One {who} court may direct otherwise within ten days of the notice that it", f"gave to {who} users."]
            cut = 1 if (k + page) % 3 else 2
            lines += body[:cut] + [HEADS[0], str(page + 2)] + body[cut:]
        out.append("\n".join(lines))
    return out


def fitted(texts, rounds=3):
    rows, pages = [], []
    for t in texts:
        f = S.line_features([t], False)
        pages.append(np.arange(len(rows), len(rows) + len(f)))
        rows += f
    symbols, seeds = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    model, likes = S.fit_model(S.seed_counts(symbols, seeds)), []
    for _ in range(rounds):
        counts, like = S.expected_counts(pages, symbols, seeds, model, 100.0)
        model = S.fit_model(counts)
        likes.append(like)
    return rows, pages, symbols, seeds, model, likes


def test_the_model_labels_heads_that_seeds_leave_open():
    rows, pages, symbols, seeds, model, likes = fitted(results())
    heads = [i for i, r in enumerate(rows) if r[2] == HEADS[0]]
    left = [i for i in heads if seeds[i] < 0]
    assert left  # rules alone don't know them
    states = S.viterbi(pages, symbols, model)
    assert all(states[i] == S.HEAD for i in heads) and all(states[i] == S.NUMBER for i, r in enumerate(rows) if r[2].isdigit())
    assert not [i for i, r in enumerate(rows) if states[i] == S.HEAD and r[2] != HEADS[0]]
    assert likes[-1] > likes[0]


def test_forward_backward_equals_every_path_counted():
    rng = np.random.default_rng(1)
    n = len(S.STATES)
    model = S.Model(rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), rng.dirichlet(np.ones(S.SYMBOLS), n))
    symbols, seeds = rng.integers(0, S.SYMBOLS, 7), np.full(7, -1)
    pages = [np.arange(3), np.arange(3, 7)]
    counts, like = S.expected_counts(pages, symbols, seeds, model, 10.0)
    want, total, best = np.zeros(n + n * n), 0.0, []
    for page in pages:
        weights = {}
        for path in np.ndindex(*[n] * len(page)):
            w = model.first[path[0]] * np.prod([model.show[s, symbols[i]] for s, i in zip(path, page)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            weights[path] = w
        z = sum(weights.values())
        total += np.log(z)
        best += max(weights, key=weights.get)
        for path, w in weights.items():
            want[path[0]] += w / z
            for a, b in zip(path, path[1:]):
                want[n + a * n + b] += w / z
    assert np.allclose(counts[: n + n * n], want) and np.isclose(like, total)
    assert list(S.viterbi(pages, symbols, model)) == [int(s) for s in best]


def test_candidates():
    assert "glass" in candidates("gla5s") and "territory" in candidates("terrifory") and "(глава" in candidates("(гпава")
    assert "permit" in candidates("perm!f") and candidates("a1b2c3d4") == {}
    long = "x" * 5000 + "rn"
    assert "x" * 5000 + "m" in candidates(long) and len(candidates(long)) < 60_000


def test_repairs_stand_where_the_misreadings_stood(spark):
    base = ["The carrier must keep the territory register of permits.", "A territory in the register is a territory of permits."] * 5
    noisy = "\n".join(["THE CARRIER MUST KEEP THE TERRIFORY REGISTER AND THE cat1e.", "Terrifory of the terrifory-register and terrifories, the perrn-", "its of it."])
    rows = [(i, "\n".join(base), None) for i in range(4)] + [(9, noisy, None)]
    df = spark.createDataFrame(rows, "ocr_id long, text string, pages array<struct<page: int, text: string, confidence: double>>")
    text = " ".join(r["text"] for r in paragraphs(df, "ocr_id").where("ocr_id = 9").orderBy("paragraph").collect())
    assert text == "THE CARRIER MUST KEEP THE TERRITORY REGISTER AND THE cat1e. Territory of the territory-register and terrifories, the permits of it."
