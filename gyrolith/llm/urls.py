"""URL filter: rules by host and path first, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table of URLs, at most LEARN_ROWS of its rows; its weights fill
one array of fixed size, whatever the pages. Judging is column expressions alone, and only pages that no rule decides
are scored. A feature is the first four hexadecimal digits of an n-gram's MD5, so that SQL can state the score.

Defined results: a null url, or one without `://`, has an empty host and path and no n-grams; repeated rows
are judged alike; among rules that fit, the one with the longest host and path decides, and of equally long ones the
last by verdict, host and path; a page that a rule decides has a null score.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features (four hexadecimal digits), lengths of n-grams, and the settings of the fit.
FEATURES, GRAMS, ROUNDS, RIDGE = 1 << 16, (3, 4, 5), 160, 5e-5
#: Labelled rows that the model is fitted on at most, and rows of the labelled table made here.
LEARN_ROWS, MADE_ROWS = 20_000, 6_000

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Words of blocked sites, of others, and of both, from which the labelled table is made by a rule.
BLOCKED = """casino poker slots jackpot betting roulette lottery bonus spin wager odds viagra pills pharma cheapmeds xxx porn adult escort cams
nude dating singles hookup warez crack keygen torrent serial nulled malware payload trojan phish verify-account login-confirm
click-track adserver popunder redirect doubler get-rich payday loans-fast replica backlinks clickbait spyware ransom""".split()  # fmt: skip
ALLOWED = """wiki encyclopedia library books novel museum exhibits university research papers journal science articles history recipes kitchen garden
spring weather forecast transit routes hospital health school lessons math council services archive documents football results
datasets population poetry review bookshop catalog developer reference software guide makers forum news world-report travel cities photo""".split()  # fmt: skip
SHARED = """the my best free online daily city open new top first www en de fr es m blog shop portal page index item view list post 2023 about home""".split()
ENDINGS = "example example.org example.net example.com test site.example invalid".split()


# Syllables of made-up names, which mean nothing, and what stands before a host's name.
SYLLABLES = "ba be co da el fa gi ha in jo ka lo mi na or pe qui ro sa te un va wi xe ya zo th sh ing er on st br tr nd le al an".split()
BEFORE = ("", "", "www.", "m.", "blog.")


def labelled_urls(n: int = MADE_ROWS, seed: int = 5) -> list[tuple[str, int]]:
    """(url, blocked): by turns of either kind, in hosts and paths of one make; ordinary ones are of three sorts.

    Blocked URLs have words of blocked sites in host or path. Half of the ordinary ones have words of ordinary sites, the others
    names without meaning or words that both kinds have, so that a URL that says nothing is ordinary.
    """
    rng, out = np.random.default_rng(seed), []
    pick = lambda words: words[int(rng.integers(len(words)))]
    name = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(2, 6))))
    plain = lambda: name() if rng.random() < 0.6 else pick(SHARED)
    for k in range(n):
        own = BLOCKED if k % 2 else ALLOWED
        if k % 4 == 0:
            host, path = [plain() for _ in range(int(rng.integers(1, 3)))], [plain() for _ in range(int(rng.integers(3)))]
        else:
            host = [pick(own) if rng.random() < 0.8 else plain(), *(plain() for _ in range(int(rng.integers(2))))]
            path = [pick(own) if rng.random() < 0.7 or host[0] not in own else plain(), *(plain() for _ in range(int(rng.integers(3))))]
        rng.shuffle(host)
        rng.shuffle(path)
        if rng.random() < 0.5:
            path.append(str(int(rng.integers(10_000))) + pick(["", "", ".html", "/"]))
        out.append((f"http{'s' * int(rng.integers(2))}://{pick(BEFORE)}{pick('-.').join(host)}.{pick(ENDINGS)}/{'/'.join(path)}", k % 2))
    return out


def host_of(url: str) -> str:
    """SQL for the part after the first `://` up to / ? # or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '')"


def path_of(url: str) -> str:
    """SQL for what follows the host up to ? # or the end."""
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def fitting_rule(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, as columns; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def features(host, path):
    """Hashed features of the n-grams of ^host$ and ^path$, each once, as a column."""
    def of(part: str, text):
        framed = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def digits(chars, k, n: int):
            gram = F.concat(F.lit(part), *(F.get(chars, k + i) for i in range(n)))
            return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 4), 16, 10).cast("int")

        def of_length(chars, n: int):
            starts = F.sequence(F.lit(0), F.size(chars) - n)
            return F.when(F.size(chars) >= n, F.transform(starts, lambda k: digits(chars, k, n))).otherwise(F.array().cast("array<int>"))

        # Characters are bound as a variable, so that a text is split once and not for each n-gram.
        lists = F.transform(F.array(framed), lambda chars: F.concat(*(of_length(chars, n) for n in GRAMS)))
        return F.when(text != "", lists[0]).otherwise(F.array().cast("array<int>"))

    found = [of("h", host), of("p", path)]
    return F.array_distinct(F.concat(*found))


def split_url(url: str) -> tuple[str, str]:
    """(host, path), for the labelled table's rows."""
    _, there, rest = url.partition("://")
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest)) if there else 0
    rest, host = (rest[cut:], rest[:cut]) if there else ("", "")
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def grams(host: str, path: str) -> list[int]:
    framed = [(part, f"^{t}$") for part, t in (("h", host), ("p", path)) if t]
    return sorted({int(hashlib.md5(f"{part}{t[k : k + n]}".encode()).hexdigest()[:4], 16) for part, t in framed for n in GRAMS for k in range(len(t) - n + 1)})


def fit(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression by accelerated steps; a row's features share unit length."""
    rows = [grams(*split_url(u)) for u, _ in labelled]
    y = np.array([float(b) for _, b in labelled])
    row, at = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.array([f for r in rows for f in r], np.int64)
    size = np.array([max(1, len(r)) ** -0.5 for r in rows])
    w, b = np.zeros(FEATURES), 0.0
    ahead, step = w, 8.0
    for k in range(ROUNDS):
        z = np.bincount(row, ahead[at], len(rows)) * size + b
        error = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(at, (error * size)[row], FEATURES) / max(1, len(y)) + RIDGE * ahead
        new = ahead - step * slope
        ahead, w = new + k / (k + 3) * (new - w), new
        b -= error.mean() if len(y) else 0.0
    return np.round(w, 6), round(b, 6)


@cache
def own_model() -> tuple[np.ndarray, float]:
    return fit(labelled_urls())


def block_score(found, weights: np.ndarray, bias: float):
    """The probability that a page with these features is to be blocked."""
    held = F.split(F.lit(",".join(f"{x:g}" if x else "0" for x in weights)), ",").cast("array<double>")  # folded to one constant
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(held, f))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.lit(1), F.size(found))) + bias)))


def judge(pages: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """The rows with host, path, rule, verdict and block_score, which replace columns of those names.

    `labelled` has columns url and blocked; without it the model comes from the table made here.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    if url.lower() in made:
        raise ValueError("the url column's name is that of a result")
    if labelled is None:
        model = own_model()
    else:
        some = labelled.where("url IS NOT NULL AND blocked IN (0, 1)").orderBy(F.xxhash64("url"), "url", "blocked").limit(LEARN_ROWS)
        model = fit([(r["url"], r["blocked"]) for r in some.select("url", "blocked").collect()])
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    rows = pages.select(*rest, F.expr(host_of(f"`{url}`")).alias("host"), F.expr(path_of(f"`{url}`")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    score = F.when(F.col("verdict").isNull(), block_score(features(F.col("host"), F.col("path")), *model))
    rows = rows.withColumn("block_score", score)
    return rows.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The same rows in DuckDB: rules as a table, and the score from the weights as one list."""
    weights, bias = own_model()
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lists = [f"list_transform(range(1, length(t{part}) - {n - 2}), lambda k: CAST('0x' || md5('{part}' || substr(t{part}, k, {n}))[1:4] AS INT))" for part in "hp" for n in GRAMS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{upper.lower()}'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {rules}) r(what, h, p)),
m AS (SELECT a.*, what, h || p AS rule FROM a LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC) = 1),
t AS (SELECT *, CASE WHEN host = '' THEN '' ELSE '^' || host || '$' END AS th, CASE WHEN path = '' THEN '' ELSE '^' || path || '$' END AS tp FROM m),
f AS (SELECT *, list_distinct({reduce(lambda x, y: f"list_concat({x}, {y})", lists)}) AS f FROM t),
w AS (SELECT [{", ".join(f"{x:g}" if x else "0" for x in weights)}]::DOUBLE[] AS w)
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN coalesce(list_sum(list_transform(f, lambda x: w[x + 1])), 0) / sqrt(greatest(1, len(f))) + {bias} >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f, w"""
