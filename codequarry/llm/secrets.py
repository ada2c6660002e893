"""Secret scans with a random forest that removes false positives, by built-in functions only.

Candidates are values announced by a secret's name and a separator, by "Bearer" or by a user in an
address (scheme://user:value@), of any signs and at least LEAST_ANNOUNCED characters, and runs of at
least LEAST_LENGTH characters of secrets' alphabets, which end at an inner "=". A comma or semicolon
belongs to a value unless a blank, a quote or another name with a separator follows. Their features (length, shares of digits and capitals, mean
log-likelihood of the transitions between characters, changes of kind, distinct characters,
coverage by a dictionary of word parts, a path, the words before and after) are SQL expressions.
The forest is trained on a labelled table (``labelled``: FINDINGS rows, real forms of secrets and
of what looks like them), and the table of transitions is counted from WORDS; both become
expressions, so that scanning runs no code outside the engine.

Defined results: null is the empty text and has no candidates; rows repeated give repeated
results; empty tables give no rows; other columns are left out, whatever their names; very long
texts are read whole; candidates don't overlap, the leftmost one is taken; a score of just CUT is
a secret.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

LEAST_LENGTH, LEAST_ANNOUNCED = 16, 6
FINDINGS = 1_600
TREES, DEPTH, LEAF = 21, 7, 3
CUT = 0.5

# Names of secrets, words before harmless strings, prefixes that services give keys,
# words whose letters the transitions and the dictionary are made from.
SECRET_NAMES = "password passwd passphrase pwd secret token api_key apikey api-key access_key accesskey private_key credential credentials auth bearer"
HARMLESS_WORDS = "sha1 sha256 sha512 md5 commit checksum digest uuid guid id etag hash revision build version example placeholder dummy sample integrity image"
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- xoxa- sk_live_ sk_test_ rk_live_ sk- AIza eyJ"
WORDS = "about after again all and any application are available back because before being between both build business but cache can change class client code command common company computer config content control country create current data database day default delete demo design development directory document download each east element end error event every example export false family field file find first folder following for form from function general get give good government great group hand handler have help here high history home house how http icon image implementation import important index information input interface into item java job key know language large last layout left level library life like line list little load local long make manager many master mean member message method model module more most name national need network new next north not note number object offer often old only open order other output over own package page parent part path people person place point position possible power present problem process program project property provider public question read record release report request resource response result return right root school second section see server service session set should show side site small social some source south start state static status still stream string study style such support system table take target template test text than that the their them then there these they thing this through time title today tool total train tree true type under update upload use user using value version view was water way web week well west what when where which while who will window with without word work world would write year you your zone und der die das nicht ein eine mit auf für von den les des une que pour dans est pas los las para con por del como"

_names = "|".join(SECRET_NAMES.split())
#: An announced value (group 1), or a run; the name before the value belongs to the match.
_separated = rf"(?i:{_names})[\"'\]]?(?:[ \t]{{0,3}}[:=]{{1,2}}>?[ \t]{{0,3}}|[ \t]{{1,3}}is[ \t]{{1,3}})[\"'`]?(?:(?i:bearer|basic)[ \t]{{1,3}})?"
ANNOUNCED = rf"(?:{_separated}|(?i:bearer[ \t]{{1,3}}))"
_sign, _inner = r"[^\s\"'`<>,;]", r"[,;](?=[^\s\"'`<>,;])(?![\w.-]{1,40}[ \t]{0,3}[:=])"
VALUE = rf"(?=(?:{_sign}|{_inner}){{{LEAST_ANNOUNCED}}})(?:{_sign}++|{_inner})++"
#: The password of an address: what stands between the user's colon and the next @.
IN_ADDRESS = rf"://[^\s:@/\"'`<>]{{0,64}}:(?=[^\s@/\"'`<>]{{{LEAST_ANNOUNCED}}})[^\s@/\"'`<>]++(?=@)"
RUN = rf"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{LEAST_LENGTH},}}={{0,2}}"
PATTERN = rf"{IN_ADDRESS}|{ANNOUNCED}{VALUE}|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{{{LEAST_LENGTH}}})[A-Za-z0-9_+/-]+?{ANNOUNCED}{VALUE}|{RUN}"
#: Characters of the text before and after a candidate that are looked at.
NEAR = 40
FEATURES = ("length", "digits", "capitals", "signs", "transitions", "changes", "distinct", "words", "path", "secret", "harmless", "hex", "prefix", "grouped", "followed")


@lru_cache(maxsize=1)
def transitions() -> tuple[str, str, str]:
    """Pairs of characters of the folded alphabet (letters, 0 for digits, others as -) by how
    often words have them: often, at times, and hardly ever is what is in neither."""
    counts = Counter(p for w in WORDS.split() for p in zip(w, w[1:], strict=False))
    order = [a + b for (a, b), _ in counts.most_common()]
    often = order[: len(order) // 3]
    return "|".join(sorted(often)), "|".join(sorted(order[len(order) // 3 :])), "|".join(sorted({w for w in WORDS.split() if len(w) > 2}, key=lambda w: (-len(w), w)))


def features(before: Column, value: Column, after: Column) -> dict[str, Column]:
    """Numbers about a candidate, the text before it on its line, and the text after it."""
    often, at_times, words = transitions()
    n = F.length(value).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    low = F.lower(value)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    near = F.lower(before)
    user = near.rlike("://[^\\s:@/]*:$")
    pairs = lambda pattern: F.regexp_count(low, F.lit(f"(?=(?:{pattern}))"))
    first, second, rest = pairs(often).cast("double"), pairs(at_times).cast("double"), F.greatest(n - 1, F.lit(1.0))
    # mean log-likelihood of a transition: classes of the learned pairs stand for their members
    likelihood = (first * F.lit(math.log(0.012)) + second * F.lit(math.log(0.002)) + F.greatest(rest - first - second, F.lit(0.0)) * F.lit(math.log(0.0001))) / rest
    return {
        "length": n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "signs": share("[A-Za-z0-9]"),
        "transitions": likelihood,
        "changes": F.length(kinds) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        "words": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "path": (value.rlike("^[./~]|/[A-Za-z.]+/|^[a-z]+://") | (near.rlike("(://|www\\.|/)\\S*$") & ~user)).cast("double"),
        "secret": (user | near.rlike(f"({_names})[\\w\"'\\]]*\\s*([:=>]|is)*\\s*[\"'`]?((bearer|basic)\\s+)?$")).cast("double"),
        "harmless": (near.rlike(f"\\b({'|'.join(HARMLESS_WORDS.split())})\\b\\W{{0,4}}$") | low.rlike("^(sha1|sha256|sha384|sha512|md5)[:_-]")).cast("double"),
        "hex": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "prefix": value.rlike(f"^({'|'.join(KEY_PREFIXES.split())})").cast("double"),
        "grouped": value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\\$\\{|\\{\\{|^%|\\*\\*\\*|\\(").cast("double"),
        "followed": after.rlike("^[(\\[.]|^\\s*(is|must|should|or|and|was|field|for)\\b").cast("double"),
    }


def labelled(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, 1 for a secret): forms of secrets and of what looks like them,
    filled from a seed."""
    r = random.Random(seed)
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    up, hexa, b64 = low.upper(), "0123456789abcdef", low + low.upper() + num
    pick = lambda s, k: "".join(r.choices(s, k=k))
    words = [w for w in WORDS.split() if len(w) > 2]
    # letters of words the dictionary doesn't hold
    odd = lambda: "".join(r.choice(("ba", "re", "ti", "on", "lu", "she", "tor", "na", "vi", "mel", "ka", "ent", "ou", "ze", "ing", "ly")) for _ in range(r.randint(2, 4)))
    word = lambda: r.choice(words) if r.random() < 0.6 else odd()
    prose = lambda: r.choice(["", "", " ".join(word() for _ in range(r.randint(1, 4))) + " "])
    named = lambda: r.choice(["", "my_", "db_", "DB_", "user ", "AWS_"]) + r.choice(SECRET_NAMES.split()) + r.choice(["=", ": ", " = ", '="', ' = "', '": "', ":", "='", " is "])
    plain = lambda: prose() + r.choice(["", "", "", "value=", "name: ", "(", '"', "key "])
    case = lambda w: r.choice([w, w.capitalize(), w.upper()])

    def password() -> str:
        body = r.choice([case(word()) + pick(num, r.randint(1, 4)), case(word()) + pick(num, r.randint(1, 2)) + word(), pick(b64, r.randint(8, 14)), case(word()) + pick("!@#$%&*", 1) + pick(num, 3), word().replace("o", "0").replace("e", "3").replace("a", "4") + pick("!&x%", 1) + pick(b64, 3)])
        return body + r.choice(["", "!", pick("!$%&?", 1) + pick(b64, 2)])

    secrets = (
        lambda: (plain(), "AKIA" + pick(up + num, 16)),
        lambda: (plain(), r.choice(["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza", "gho_"]) + pick(b64, r.randint(18, 40))),
        lambda: (plain(), "eyJ" + pick(b64 + "_-", r.randint(20, 80))),
        lambda: (prose() + named(), pick(r.choice([hexa, b64, low + num, b64 + "+/", up + num]), r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (prose() + named(), pick(b64 + "+/", r.choice([22, 43])) + "="),
        lambda: (prose() + named(), pick(b64 + "-_.", r.randint(12, 30))),
        lambda: (prose() + named(), password()),
        lambda: (prose() + named(), password() + r.choice(",;") + password() + r.choice(["", ";" + pick(num, 1)])),
        lambda: (prose() + r.choice(["mysql", "postgres", "redis", "https", "amqp", "mongodb+srv", "ftp"]) + "://" + r.choice(["", word(), "root", "admin"]) + ":", r.choice([password, lambda: pick(b64, r.randint(10, 32))])()),
        lambda: (prose() + r.choice(["Authorization: Bearer ", "bearer ", "-H 'Authorization: Bearer ", '"Authorization": "Bearer ', "auth: Basic "]), r.choice([pick(b64, r.randint(16, 48)), pick(b64, r.randint(3, 20)) + "." + pick(b64 + "_-", r.randint(4, 40)) + "." + pick(b64, r.randint(4, 30)), pick(hexa, 32)])),
    )
    harmless = (
        lambda: (prose() + r.choice(HARMLESS_WORDS.split()) + r.choice([": ", " ", "=", " = "]), pick(hexa, r.choice([16, 32, 40, 64]))),
        lambda: (plain(), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (prose() + r.choice(['integrity="', "integrity=", "integrity: ", '"integrity": "', "", "digest: "]), r.choice(["sha256", "sha384", "sha512", "sha1"]) + "-" + pick(b64 + "+/", r.choice([27, 43, 64, 86])) + r.choice(["", "=", "=="])),
        lambda: (prose() + r.choice(["etag: ", "checksum=", "integrity: ", "digest = "]), pick(b64 + "+/", r.choice([22, 27, 43])) + r.choice(["", "="])),
        lambda: (prose() + r.choice(["postgres", "https", "mysql", "redis"]) + "://" + r.choice(["user", "username", ""]) + ":", r.choice(["password", "passwd", "${PASSWORD}", "${DB_PASS}", "{{ password }}"[:11], "changeme", "your-password", "********", "%(password)s"])),
        lambda: (prose() + r.choice(["bearer ", "Bearer ", "Authorization: Bearer "]), r.choice(["authentication", "tokens", "shares", "${TOKEN}", "{{access", "your-" + word() + "-token", "instrument", word().ljust(6, "s"), "$ACCESS_TOKEN", "xxxxxxxx"])),
        lambda: (plain(), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (plain(), r.choice("_-").join(word() for _ in range(r.randint(3, 6)))),
        lambda: (plain(), "".join(case(word()) for _ in range(r.randint(3, 6)))),
        lambda: (plain(), "".join(word() for _ in range(r.randint(3, 6)))),
        lambda: (prose() + r.choice(["http://www.example.com/", "/usr/", "src/", "https://", "./"]), "/".join(word() for _ in range(r.randint(3, 6))) + r.choice(["", pick(num, 2)])),
        lambda: (plain(), pick(num, r.randint(16, 22))),
        lambda: (plain(), r.choice("=-_+/") * r.randint(16, 60)),
        lambda: (prose() + 'src="data:image/png;base64,', pick(b64 + "+/", r.randint(40, 200))),
        lambda: (prose() + named(), r.choice(["x" * r.randint(6, 24), "your-" + word() + "-here", "<" + word() + ">", "${" + word().upper() + "_" + word().upper() + "}", "{{ " + word(), "CHANGE_ME", "changeme", "********", "%(" + word() + ")s", "process.env." + word().upper(), "os.environ[" + word(), "null", "undefined", "required", "example", "placeholder"]).ljust(6, "x")),
        lambda: (prose() + named(), r.choice(["_", "-", "", "."]).join(word() for _ in range(r.randint(2, 5))).ljust(6, "e")),
        lambda: (prose() + r.choice(SECRET_NAMES.split()) + " is ", word().ljust(6, "s")),
        lambda: (prose() + named(), "get" + case(word()).capitalize() + r.choice(["(", "()", "(self)", "[0]"])),
    )
    out = []
    for i in range(n):
        bad = i % 2
        before, value = r.choice(secrets if bad else harmless)()
        after = "@" + r.choice(["localhost", word() + ".com", "db"]) if "://" in before and before.endswith(":") else r.choice(["", '"', "'", " " + word(), "\n", ".", ", " + word()]) if bad else r.choice(["", '"', " " + word(), "\n", " is", "(", ".", " must be", ", " + word()])
        out.append((before[-NEAR:], value, after, bad))
    return out


def _grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int):
    """(feature, cut, low, high), or the share of secrets in a leaf."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in r.choice(x.shape[1], 5, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        fine = np.flatnonzero((v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF))
        if not len(fine):
            continue
        n, left = n[fine], ones[fine]
        right = ones[-1] - left
        gini = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        k = int(np.argmin(gini))
        if best is None or gini[k] < best[0]:
            best = (gini[k], int(f), float(v[fine[k]] + v[fine[k] + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], r, depth - 1), _grow(x[~low], y[~low], r, depth - 1)


def train(findings: DataFrame, seed: int = 5) -> list:
    """The forest, from a table of before, value, after and y (1 for a secret), FINDINGS rows or
    so: they come to the driver. Their features come from the same expressions as the scan's."""
    rows = findings.select(*(v.alias(k) for k, v in features(F.col("before"), F.col("value"), F.col("after")).items()), "y").orderBy(*FEATURES, "y").toArrow()
    found = np.stack([np.asarray(rows[k], float) for k in (*FEATURES, "y")], axis=1)
    r = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        own = r.integers(0, len(found), len(found))
        trees.append(_grow(found[own, :-1], found[own, -1], r, DEPTH))
    return trees


def training_table(spark, n: int = FINDINGS, seed: int = 11) -> DataFrame:
    return spark.createDataFrame(labelled(n, seed), "before string, value string, after string, y int")


def _expression(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    k, cut, low, high = tree
    return F.when(f[FEATURES[k]] <= F.lit(cut), _expression(low, f)).otherwise(_expression(high, f))


def forest_score(trees: list, f: Column) -> Column:
    """The mean of the trees, from a struct of features."""
    return reduce(lambda a, b: a + b, (_expression(t, f) for t in trees)) / F.lit(float(len(trees)))


def scan(documents: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, and found, an array of (start, end, value, score) in text
    order, from 0, the end exclusive. All of it happens inside the row: nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    # most texts hold no candidate: cheap tests first
    named = lambda t: reduce(lambda a, b: a | b, (t.contains(x) for x in (*SECRET_NAMES.split(), "://")))
    likely = once(F.lower(text), named) | text.rlike(rf"[A-Za-z0-9_+/-]{{{LEAST_LENGTH}}}")
    matches = F.when(likely, F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(none)
    between = F.when(likely, F.split(text, PATTERN, -1)).otherwise(none)

    def described(whole: Column, start: Column, gap: Column, after: Column) -> Column:
        value = F.when(whole.rlike(rf"^{RUN}$"), whole).otherwise(F.regexp_extract(whole, rf"^(?:://[^:]*+:|.*?{ANNOUNCED})({VALUE}|(?<=:)[^\s@/\"'`<>]+)$", 1))

        def with_value(value: Column) -> Column:
            lead = F.length(whole) - F.length(value)
            before = F.regexp_extract(F.concat(F.right(gap, F.lit(NEAR)), F.substring(whole, F.lit(1), lead)), rf"[^\n]{{0,{NEAR}}}$", 0)
            f = once(before, lambda b: F.struct(*(v.alias(k) for k, v in features(b, value, after).items())))
            return F.struct((start + lead).alias("start"), value.alias("value"), f.alias("f"))

        return once(value, with_value)

    def located(x: Column) -> Column:
        # where each match begins: the lengths of what stands before it, summed up
        sizes = F.transform(x["m"], lambda m, i: F.struct(F.length(F.get(x["gaps"], i)).alias("gap"), F.length(m).alias("size")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, zero, lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["gap"])).alias("starts")))["starts"]
        return once(starts, lambda at: F.transform(x["m"], lambda m, i: described(m, F.get(at, i), F.get(x["gaps"], i), F.substring(F.get(x["gaps"], i + 1), 1, NEAR))))

    kept = F.filter(once(F.struct(matches.alias("m"), between.alias("gaps")), located), lambda d: F.length(d["value"]) > 0)
    scored = F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (d["start"] + F.length(d["value"])).alias("end"), d["value"].alias("value"), forest_score(trees, d["f"]).alias("score")))
    return documents.select(F.col(id_col), F.explode(F.array(scored)).alias("found"))


def secrets_of(found: Column) -> Column:
    return F.filter(found, lambda c: c["score"] >= CUT)


def redact(documents: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, each secret replaced by <SECRET>."""
    joined = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("whole_text"))
    found = scan(joined.withColumn("found_id", F.struct(id_col, "whole_text")), trees, "found_id", "whole_text")
    spans = secrets_of(F.col("found"))

    def gap(k: Column, s: Column, text: Column) -> Column:
        start = F.coalesce(F.get(s, k - 1)["end"], F.lit(0))
        return F.substring(text, start + 1, F.coalesce(F.get(s, k)["start"], F.length(text)) - start)

    return found.select(F.col(f"found_id.{id_col}").alias(id_col), F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: gap(k, spans, F.col("found_id.whole_text"))), "<SECRET>").alias("text"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (values sorted, comma-joined) and their spans
    (start:end in text order, comma-joined) of every row."""
    found = scan(documents, train(training_table(documents.sparkSession)))
    secrets = secrets_of(F.col("found"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.array_join(F.array_sort(F.transform(secrets, lambda c: c["value"])), ",").alias("secrets"),
        F.array_join(F.transform(secrets, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",").alias("spans"),
    )
