"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators (patterns) propose spans that may overlap; one run of digits is a candidate for a card and for a phone
number. Each candidate becomes a few small categories of format (digits, separators, lead, arithmetic check) and context (characters
beside it, words before it). Boosted trees score them; they learn from candidates whose format settles the question, one way or the
other, and the thresholds are calibrated on documents the trees have not seen. Candidates whose format leaves it open are redacted by
score. Spans that the base rules find always stay.

All candidates of the corpus are counted by category in one aggregate, so the fit sees every row, yet what reaches the driver is
bounded by the number of categories (at most 48,000 a kind and fold), not by the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_FREE = r"[^\s@<>()\[\],;:\x22']"
#: generator -> (pattern, what a text must hold). The first four are the base rules; possessive repeats and the look-behind leave their
#: matches as they are and keep long runs linear. A card needs 14 digits in a row, which selects among whole matches.
GENERATORS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){13,}+", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "digits": (r"(?:(?<![0-9(+])|\G)[(+]?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+", "[0-9]"),
    "free_email": (rf"(?:(?<!{_FREE})|\G){_FREE}++@{_FREE}++", "@"),
    "spoken_email": (rf"(?i)(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?(?:[\[({{]at[\])}}]\x20?{_LABEL}++(?:\x20?(?:[\[({{]dot[\])}}]|\.)\x20?{_LABEL}++)++"
                     rf"|\x20at\x20{_LABEL}++(?:\x20dot\x20{_LABEL}++)++)", r"(?i)[\[({ ]at[\])} ]"),
    # what the base rules lose where numbers stand side by side
    "shaped_card": (r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", "[0-9]{4}"),
    "shaped_phone": (r"(?<![0-9])\+?[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", "[0-9]{4}"),
    "long_ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r":[0-9A-Fa-f]{1,4}:"),
}
#: which kinds a generator's match is a candidate for
ASKS = {"email": ["email"], "ip": ["ip"], "card": ["card"], "phone": ["phone"], "digits": ["card", "phone"], "free_email": ["email"], "spoken_email": ["email"],
        "shaped_card": ["card"], "shaped_phone": ["phone"], "long_ip": ["ip"]}
WORDS = {"email": "mail|e-mail|email|contact|write|correo|courriel", "ip": "ip|host|server|address|from|client", "card": "card|visa|master|amex|credit|pay|karte|carte|tarjeta",
         "phone": "phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono"}
OTHER_WORDS = "isbn|order|invoice|version|serial|sku|id|no|nr|bestellung|commande|pedido"
CONTEXT = 24
#: category -> number of its values
FEATURES = {"f_digits": 8, "f_parts": 6, "f_lead": 5, "f_check": 2, "f_left": 5, "f_right": 5, "f_word": 2, "f_other": 2}
ROUNDS, RATE, SMOOTH, PRECISION = 24, 0.3, 1.0, 0.995


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check of card numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether every dotted part is at most 255, leading zeros aside."""
    return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def find_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, found): for each row, every generator's matches in order, with the code points before each and what stands beside it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for name, (pattern, needs) in GENERATORS.items():
        pieces, hits = F.split("t", pattern, -1), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        before = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.substring(p, -CONTEXT, CONTEXT).alias("left")))
        rows = F.zip_with(hits, F.slice(before, 1, F.size(hits)), lambda m, p: F.struct(m.alias("m"), p["gap"].alias("gap"), p["left"].alias("left")))
        following = F.transform(F.slice(pieces, 2, F.size(hits)), lambda p: F.substring(p, 1, 1))
        beside = F.zip_with(rows, following, lambda r, f: F.struct(r["m"].alias("m"), r["gap"].alias("gap"), r["left"].alias("left"), f.alias("right")))
        whole = F.transform(beside, lambda r, i: F.struct(F.lit(name).alias("gen"), i.alias("i"), *[r[c].alias(c) for c in ("m", "gap", "left", "right")]))
        empty = F.array().cast("array<struct<gen:string,i:int,m:string,gap:int,left:string,right:string>>")
        parts.append(F.when(F.col("t").rlike(needs), whole).otherwise(empty))
    seen = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("t"))
    return durable(seen.select("rid", "id", F.concat(*parts).alias("found")))


def _beside(c: Column) -> Column:
    return (F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\p{P}$"), 3).otherwise(4))


def candidates(found: DataFrame) -> DataFrame:
    """(rid, id, gen, i, gap, chars, kind, base, known, f_...): a row for each match and kind it may be; rows without a match stay, with nulls.

    `base` says that the base rules accept the match, `known` whether its format settles the question (1, 0, or null)."""
    one = found.select("rid", "id", F.explode_outer("found").alias("f")).select("rid", "id", "f.*")
    asked = F.create_map(*[x for g, ks in ASKS.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))])[F.col("gen")]
    rows = one.withColumn("chars", F.length("m")).withColumn("digits", F.regexp_replace("m", "[^0-9]", "")).withColumn("n", F.length("digits")).select("*", F.explode_outer(asked).alias("kind"))
    m, n, kind = F.col("m"), F.col("n"), F.col("kind")
    checked = (F.when(kind == "card", F.when((n >= 12) & (n <= 19), _luhn(F.col("digits"))).otherwise(False))
               .when(kind == "ip", F.when(F.col("gen") == "ip", _octets(m)).otherwise(True))
               .when(kind == "phone", m.rlike(r"[0-9]{3}[\x20)./-]{1,2}[0-9]{3}[\x20./-]?[0-9]{4}$"))
               .when(kind == "email", m.rlike(r"\.[A-Za-z]{2,}$")).otherwise(False))
    rows = rows.withColumn("ok", checked)
    base = (F.when(F.col("gen") == "email", True).when(F.col("gen") == "ip", F.col("ok")).when(F.col("gen") == "card", (n <= 19) & F.col("ok"))
            .when(F.col("gen") == "phone", (n >= 10) & (n <= 15)).otherwise(False))
    card_like, mail = m.rlike(r"^[0-9](?:[\x20-]?[0-9])++$"), m.rlike(rf"^{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++$")
    glued = F.substring("left", -1, 1).rlike(r"^[\p{L}_]$") | F.col("right").rlike(r"^[\p{L}_]$")  # a piece of a longer token
    known = (F.when(kind == "card", F.when((n >= 14) & (n <= 19) & card_like, F.col("ok").cast("int")).when((n < 12) | (n > 19), 0))
             .when(kind == "phone", F.when(m.startswith("+"), ((n >= 10) & (n <= 15)).cast("int")).when((n > 15) | (n < 7) | glued | m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 0))
             .when(kind == "ip", F.when(F.col("gen") == "ip", F.col("ok").cast("int")))
             .when(kind == "email", F.when(mail, 1).when(m.contains("@") & ~F.substring_index(m, "@", -1).contains("."), 0)))
    seps = F.regexp_replace("m", "[0-9+]", "")
    left, word = F.col("left"), F.create_map(*[x for k, w in WORDS.items() for x in (F.lit(k), F.lit(rf"(?i)(?<!\p{{L}})(?:{w})(?!\p{{L}})"))])
    features = {
        "f_digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7),
        "f_parts": F.when(F.length(seps) == 0, 0).when(seps.rlike(r"^\x20+$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).when(seps.contains("("), 4).otherwise(5),
        "f_lead": F.when(m.startswith("+"), 1).when(m.startswith("00"), 2).when(m.startswith("("), 3).when(m.startswith("0"), 4).otherwise(0),
        "f_check": F.col("ok").cast("int"), "f_left": _beside(F.substring(left, -1, 1)), "f_right": _beside(F.col("right")),
        "f_word": F.coalesce(F.expr("rlike(`left`, `_word`)"), F.lit(False)).cast("int"), "f_other": F.coalesce(left.rlike(rf"(?i)(?<!\p{{L}})(?:{OTHER_WORDS})(?!\p{{L}})"), F.lit(False)).cast("int")}
    rows = rows.withColumn("_word", word[kind])
    return rows.select("rid", "id", "gen", "i", "gap", "chars", "kind", base.alias("base"), known.alias("known"), *[c.alias(f) for f, c in features.items()])


Tree = tuple


@dataclass(frozen=True)
class Model:
    """Trees and threshold of each kind; a kind whose known candidates all say the same has neither, and adds no spans."""

    trees: dict[str, list[Tree]]
    threshold: dict[str, float]

    def score(self) -> Column:
        """Sum of the trees over the columns f_...; null for a kind without trees."""
        def written(t: Tree) -> Column:
            return F.lit(t[0]) if len(t) == 1 else F.when(F.col(t[0]) <= t[1], written(t[2])).otherwise(written(t[3]))

        out = F.lit(None).cast("double")
        for kind, trees in self.trees.items():
            out = F.when(F.col("kind") == kind, sum((written(t) for t in trees[1:]), written(trees[0]))).otherwise(out)
        return out

    def chosen(self) -> Column:
        limit = F.create_map(*[x for k, v in self.threshold.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")] if self.threshold else F.lit(None).cast("double")
        return F.coalesce(F.col("score") >= limit, F.lit(False))


def _value(tree: Tree, cell: dict) -> float:
    while len(tree) > 1:
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _grow(cells: list[tuple[dict, float, float]], depth: int) -> Tree:
    """A tree over cells (categories, gradient, curvature): the split with the greatest gain, until `depth` levels or no gain."""
    gain = lambda g, h: g * g / (h + SMOOTH)
    total_g, total_h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-9, None, None)
    for f, values in FEATURES.items() if depth else ():
        g, h = [0.0] * values, [0.0] * values
        for cell, cg, ch in cells:
            g[cell[f]] += cg
            h[cell[f]] += ch
        lg = lh = 0.0
        for v in range(values - 1):
            lg, lh = lg + g[v], lh + h[v]
            won = gain(lg, lh) + gain(total_g - lg, total_h - lh) - gain(total_g, total_h)
            if won > best[0]:
                best = (won, f, v)
    _, f, v = best
    if f is None:
        return (RATE * total_g / (total_h + SMOOTH),)
    return f, v, _grow([c for c in cells if c[0][f] <= v], depth - 1), _grow([c for c in cells if c[0][f] > v], depth - 1)


def fit(rows: DataFrame, fold: Column) -> Model:
    """Boosted trees (logistic loss) on the known candidates, thresholds from those where `fold` is true. All rows are counted, by category."""
    known = rows.where("known IS NOT NULL")
    counted = known.groupBy("kind", *FEATURES, fold.alias("held")).agg(F.sum("known").alias("yes"), F.count("*").alias("all")).collect()
    trees, threshold = {}, {}
    for kind in KINDS:
        cells = sorted(((r.asDict(), r["yes"], r["all"]) for r in counted if r["kind"] == kind), key=lambda c: [c[0]["held"], *[c[0][f] for f in FEATURES]])
        fitted = [c for c in cells if not c[0]["held"]]
        yes, every = sum(c[1] for c in fitted), sum(c[2] for c in fitted)
        if not 0 < yes < every:
            continue
        grown = [(math.log(yes / (every - yes)),)]
        margin = [grown[0][0]] * len(fitted)
        for _ in range(ROUNDS):
            odds = [1 / (1 + math.exp(-m)) for m in margin]
            tree = _grow([(c[0], c[1] - c[2] * p, c[2] * p * (1 - p)) for c, p in zip(fitted, odds)], 2)
            margin = [m + _value(tree, c[0]) for m, c in zip(margin, fitted)]
            grown.append(tree)
        judged = sorted(((sum(_value(t, c[0]) for t in grown), c[1], c[2]) for c in cells if c[0]["held"]), key=lambda x: -x[0])
        right = seen = 0
        for at, (score, good, count) in enumerate(judged):
            right, seen = right + good, seen + count
            last = at + 1 == len(judged) or judged[at + 1][0] < score
            if last and score > 0 and right >= PRECISION * seen:
                threshold[kind] = max(0.0, (score + judged[at + 1][0]) / 2 if at + 1 < len(judged) else 0.0)  # halfway to the first score refused
        if kind in threshold:
            trees[kind] = grown
    return Model(trees, threshold)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: id, and spans, an array of (start, kind number, end, base) in order of start and kind. Offsets count code points.

    Base spans always stay, also where they overlap. Of other chosen candidates that overlap, the best score stays (ties: first start, then
    kind), and none stays beside a base span it overlaps. Null texts are empty; null and repeated ids and repeated rows are worked
    out row by row. An empty table gives no rows. Other columns are not read. Without a model one is fitted on these documents.
    """
    rows = candidates(find_matches(docs, id_col, text_col))
    if model is None:
        model = fit(rows, F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    scored = rows.withColumn("score", model.score()).repartition("rid")
    # places come from the lengths of what stands before, generator by generator; then all of a document's candidates in order
    upto = W.partitionBy("rid", "gen", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = scored.withColumn("end", F.sum(F.col("gap") + F.col("chars")).over(upto)).withColumn("start", F.col("end") - F.col("chars"))
    order = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])[F.col("kind")]
    kept = placed.select("rid", "id", "start", "end", order.alias("ord"), "base", "score", model.chosen().alias("chosen")).withColumn("use", F.coalesce(F.col("base") | F.col("chosen"), F.lit(False)))
    before = W.partitionBy("rid", "use").orderBy("start", "end", "ord", F.desc("base")).rowsBetween(W.unboundedPreceding, -1)
    new = F.col("use") & (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start"))
    inside = W.partitionBy("rid", "use").orderBy("start", "end", "ord", F.desc("base")).rowsBetween(W.unboundedPreceding, 0)
    grouped = kept.withColumn("new", new).withColumn("group", F.sum(F.col("new").cast("int")).over(inside))
    whole = W.partitionBy("rid", "use", "group")
    best = F.row_number().over(whole.orderBy(F.desc("base"), F.desc("score"), "start", "ord", "end"))
    final = grouped.withColumn("stays", F.col("use") & (F.col("base") | (best == 1)))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("ord").alias("ord"), F.col("end").cast("long").alias("end"), F.col("base").alias("base"))
    got = final.groupBy("rid").agg(F.first("id").alias("id"), F.array_sort(F.collect_set(F.when(F.col("stays"), span))).alias("spans"))
    return got.select(F.col("id").alias(id_col), "spans")


def redact(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in brackets; where spans overlap, the first one stands."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("s"))
    names = F.array(*map(F.lit, KINDS))
    step = lambda a, x: F.when(x["start"] + 1 < a["at"], a).otherwise(F.struct(
        (x["end"] + 1).cast("int").alias("at"), F.concat(a["s"], F.substring(text, a["at"], (x["start"] + 1 - a["at"]).cast("int")), F.lit("["), names[x["ord"]], F.lit("]")).alias("s")))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["s"], F.substring(text, a["at"], F.length(text))))
