"""Letter runs and words of any length are cut and scored."""
import math
import random

from gridlens.llm import urlfilter as U


def _every_split(run, counts, total):
    """Viterbi over all pieces of all lengths."""
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for j in range(1, len(run) + 1):
        for i in range(j):
            n = counts.get(run[i:j])
            c = best[i] + (-math.log(n / total) if n else math.log(total) + 2.3 * (j - i))
            if c < best[j] - 1e-9:
                best[j], back[j] = c, i
    out, j = [], len(run)
    while j:
        out.append(run[back[j]:j])
        j = back[j]
    return out[::-1]


def _cost(cut, counts, total):
    return sum(-math.log(counts[w] / total) if counts.get(w) else math.log(total) + 2.3 * len(w) for w in cut)


def test_runs_of_any_length(spark):
    rng = random.Random(2)
    long = ["donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesellschaftskapitän", "ab" * 40]
    words = ["casino", "shop", "the", "a", "ab", "garden", "gardens", "x" * 24, "x" * 25, *long]
    counts = {w: rng.randint(1, 50) for w in words}
    total = sum(counts.values()) + 1000
    pick = [*words, "casino", "qzj", "pills", "r", "donaudampfschifffahrtsgesell"]
    runs = sorted({"".join(rng.choice(pick) for _ in range(k)) for k in list(range(1, 12)) * 4 + [60]} | {"q" * 600, *long, "ab" * 200})
    seeds = U.BLOCK_SEEDS
    got = U.score_runs(spark.createDataFrame([(r,) for r in runs], "run string"),
                       spark.createDataFrame(list(counts.items()), "word string, n long"), total, seeds, 4.0).collect()
    assert sorted(r["run"] for r in got) == runs and max(map(len, runs)) > 2 * U.BLOCK
    whole = total + sum(seeds.values())
    for r in got:
        model = dict(counts)
        for w, n in seeds.items():
            if w in r["run"]:
                model[w] = model.get(w, 0) + n
        want = _every_split(r["run"], model, whole)
        assert "".join(r["words"]) == r["run"]
        assert math.isclose(_cost(r["words"], model, whole), _cost(want, model, whole), abs_tol=1e-6), r["run"]
        assert math.isclose(r["score"], sum(U.log_ratio(w, counts, total, seeds, 4.0) for w in r["words"]), abs_tol=1e-6)


def test_long_runs_of_seed_words_are_blocked(spark):
    html = "<p>" + "garden shop and flowers of the town " * 300 + "</p>"
    urls = {1: "http://town.example/" + "casinopillsbonus" * 3, 2: "http://town.example/" + "casinopillsbonus" * 4,
            3: "http://town.example/" + "casinopillsbonus" * 90, 4: "http://" + "casinopills" * 8 + ".example/", 5: "http://town.example/garden"}
    df = spark.createDataFrame([(i, u, html) for i, u in urls.items()], "page_id long, url string, html string")
    got = {r["id"]: r["verdict"] for r in U.judge(df, "page_id", "url", "html", []).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
