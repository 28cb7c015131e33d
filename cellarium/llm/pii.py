"""Personal data in texts: fixed patterns, and candidates judged by boosted trees.

All work on documents is column expressions: there is no join, shuffle or Python
function on the way, so a row needs nothing but itself.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .common import let, running

#: Kinds in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone", "id", "secret"]
BASE_KINDS = KINDS[:4]

#: The base patterns. Each says what the plain pattern says; possessive repeats and
#: the look-behinds only keep the matcher from trying starts that can't succeed, and
#: from recursing on long runs. \G lets a match start where the last one ended.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: High-recall generators of further candidates; their spans may overlap. Repeats have no
#: upper end; only accounts have one, as their format has. A run of digits alone is a
#: number, never a secret. A letter right after a number is taken into its match, and the match
#: then dropped: asking the pattern itself for no letter there would have it try every later
#: digit of a long run in vain.
GENERATORS = {
    "mail": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|(?<= )at(?= )) ?"
    r"[a-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= )) ?[a-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z.+])(?<!\+[0-9]{1,3}[ -]\(?)\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+[A-Za-z]?+",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
    "secret": r"(?i)(?<![0-9a-z])(?:(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?\"?[^\s\"]{4,}+\"?"
    r"|(?![0-9]++(?![a-z_+/-]))[a-z0-9_+/-]{16,}+)",
}
GENERATOR_NAMES = list(GENERATORS)

#: What every match of the mail generator holds, so that no candidate depends on the rest of the text.
MAIL_GATE = r"(?i)@|\(at\)|\[at\]|[a-z0-9._%+-] at [a-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= ))"

#: Words before a candidate that speak for a kind, or against all.
HINTS = {
    "hint_mail": r"(?i)(mail|write to|contact|reach)",
    "hint_phone": r"(?i)(phone|tel|call|mobile|fax|ring|number is)",
    "hint_card": r"(?i)(card|visa|credit|debit|pay)",
    "hint_id": r"(?i)(ssn|social|iban|account|passport|tax)",
    "hint_secret": r"(?i)(password|passwd|pwd|secret|token|key)",
    "hint_other": r"(?i)(order|invoice|page|isbn|version|total|room|year|part no|serial|chapter|population|at noon|ref |batch|model|lot )",
}
FEATURES = [
    "length", "digits", "letters", "upper", "spaces", "dots", "dashes", "brackets", "groups", "at", "wordy_at",
    "luhn", "first_zero", "equals", "ssn", "phone_shape", "mixed", "switches", "hex_run", "generator", *HINTS,
]
CONTEXT = 28

MATCH = "struct<start:int,end:int,value:string,before:string>"


def _n(pattern: str, value: Column) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start and end in code points, end exclusive.

    The pieces between the matches give the places; what stands before a match is
    cut from its piece.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")
    )

    def placed(f: Column) -> Column:
        values, gaps = f["values"], f["gaps"]
        steps = F.transform(
            values, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0))
        )
        return let(
            running(steps, lambda a, b: a + b, F.lit(0)),
            lambda starts: F.transform(
                values,
                lambda v, i: F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + F.length(v)).alias("end"),
                    v.alias("value"),
                    F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("before"),
                ),
            ),
        )

    return let(found, placed)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # zeros before a part don't count, however many
        return F.forall(
            F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    if kind == "card":
        return let(
            digits_of(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
        )
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    return F.lit(True)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


SPAN = "struct<start:int,kind_at:int,end:int>"


def base_spans(text: Column) -> Column:
    """The spans of the base patterns as (start, place of the kind, end), sorted."""
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    gates = {"email": has_at, "phone": F.contains(text, F.lit("+")) & has_digit}

    def spans(kind: str) -> Column:
        place = F.lit(KINDS.index(kind))
        valid = F.filter(matches(text, BASE_PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        found = F.transform(
            valid, lambda m: F.struct(m["start"].alias("start"), place.alias("kind_at"), m["end"].alias("end"))
        )
        return F.when(gates.get(kind, has_digit), found).otherwise(_none(SPAN))

    return F.array_sort(F.concat(*[spans(kind) for kind in BASE_KINDS]))


def candidates(text: Column) -> Column:
    """Overlapping spans of all generators with their features."""
    gates = {
        "mail": text.rlike(MAIL_GATE),
        "number": text.rlike("[0-9]"),
        "account": text.rlike("[A-Z]{2}[0-9]{2}"),
        "secret": text.rlike("[0-9=:]"),
    }
    kind = f"struct<start:int,end:int,{','.join(f'{f}:double' for f in FEATURES)}>"

    def spans(name: str) -> Column:
        whole = matches(text, GENERATORS[name])
        if name == "number":
            whole = F.filter(whole, lambda m: ~m["value"].rlike("[A-Za-z]$"))
        found = F.transform(
            whole,
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), *_features(m, GENERATOR_NAMES.index(name))
            ),
        )
        return F.when(gates[name], found.cast(f"array<{kind}>")).otherwise(_none(kind))

    return F.concat(*[spans(name) for name in GENERATORS])


def _features(m: Column, generator: int) -> list[Column]:
    v = m["value"]
    digits = digits_of(v)
    values = {
        "length": F.length(v),
        "digits": F.length(digits),
        "letters": _n("[A-Za-z]", v),
        "upper": _n("[A-Z]", v),
        "spaces": _n("\\s", v),
        "dots": _n("\\.", v),
        "dashes": _n("-", v),
        "brackets": _n("[()\\[\\]]", v),
        "groups": _n("[0-9]+", v),
        "at": F.contains(v, F.lit("@")).cast("int"),
        "wordy_at": v.rlike(r"(?i)\(at\)|\[at\]|\(dot\)|\[dot\]").cast("int"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False).cast("int"),
        "first_zero": v.rlike("^\\(?0").cast("int"),
        "equals": v.rlike("[=:]").cast("int"),
        "ssn": v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("int"),
        "phone_shape": v.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$").cast("int"),
        "mixed": v.rlike("[0-9][A-Za-z]+[0-9]+[A-Za-z]").cast("int"),
        "switches": _n("[0-9][A-Za-z]|[A-Za-z](?=[0-9])", v),
        "hex_run": v.rlike("[0-9a-f]{16}").cast("int"),
        "generator": F.lit(generator),
        **{name: m["before"].rlike(hint).cast("int") for name, hint in HINTS.items()},
    }
    return [values[f].cast("double").alias(f) for f in FEATURES]


#: Place in KINDS of what a candidate c would be.
SPAN_KIND = """CASE WHEN c.generator = 0 THEN 0 WHEN c.generator = 2 THEN 4 WHEN c.generator = 3 THEN 5
    WHEN c.ssn = 1 THEN 4 WHEN c.digits >= 13 THEN 2 ELSE 3 END"""


def tree_margin(forest: gbdt.Forest, c: str, features: list[str] = FEATURES) -> str:
    """SQL text of the forest's log odds over the fields of the variable ``c``."""

    def grow(k: int) -> str:
        if forest.left[k] == k:
            return f"{forest.value[k]:.17g}D"
        test = f"{c}.{features[forest.feature[k]]} <= {forest.threshold[k]:.17g}D"
        return f"CASE WHEN {test} THEN {grow(int(forest.left[k]))} ELSE {grow(int(forest.right[k]))} END"

    return " + ".join([f"{forest.base:.17g}D", *(grow(int(root)) for root in forest.roots)])


def _examples(seed: int = 7, copies: int = 60) -> list[dict]:
    """Short made-up texts with one candidate each: real says whether it is personal, form
    is the number of the template."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    u = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    b = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(["an", "ber", "to", "el", "mi", "ra", "sh", "en"]) for _ in range(r.randint(2, 4)))
    yes = [
        lambda: f"{r.choice(['contact', 'mail', w()])} {w()}.{w()} (at) {w()} (dot) com",
        lambda: f"{r.choice(['write to', w()])} {w()}[at]{w()}[dot]org",
        lambda: f"{w()} {w()}{d(2)}@{w()}.example.com",
        lambda: f"{r.choice(['reach me', w()])} {w()}_{d(2)} [at] {w()} [dot] {w()} [dot] net",
        lambda: f"{r.choice(['call', 'phone', w()])} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{r.choice(['tel', 'mobile', w()])} {d(3)}-{d(3)}-{d(4)}",
        lambda: f"{r.choice(['call', 'fax', 'tel'])} 0{d(3)} {d(7)}",
        lambda: f"{r.choice(['ring', 'mobile', w()])} {d(3)}.{d(3)}.{d(4)}",
        lambda: f"{r.choice(['card', 'visa', 'credit card'])} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['pay with', 'debit', 'card'])} {d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{r.choice(['ssn', 'social security', w()])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{r.choice(['tax', 'my ssn is', w()])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{r.choice(['iban', 'account', w()])} {r.choice(['DE', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['account', 'iban', w()])} {r.choice(['GB', 'NL'])}{d(2)}{u(4)}{d(12)}",
        lambda: f"{r.choice(['iban', 'my account'])} {r.choice(['PL', 'PT', 'AT'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{r.choice(['card', 'credit', 'visa'])} {d(16)}",
        lambda: f"{w()} {r.choice(['password', 'token', 'api_key', 'secret'])}{r.choice(['=', ': ', ' = '])}{h(18)}",
        lambda: f'{w()} {r.choice(["token", "secret"])} = "{h(r.choice([32, 40, 64, 400]))}"',
        lambda: f"{w()} {r.choice(['pwd', 'password'])}: {b(r.randint(9, 24))}{d(2)}",
        lambda: f'{w()} {r.choice(["password", "api_key"])} = "{b(r.randint(12, 20))}"',
        lambda: f"{w()} AKIA{u(16)}",
        lambda: f"{r.choice(['key id', w()])} {r.choice(['ASIA', 'AIZA'])}{u(r.choice([16, 31]))}",
        lambda: f"{r.choice(['key', 'token', w()])} {h(r.choice([32, 64, 300]))}",
        lambda: f"{r.choice(['key', w()])} {b(r.choice([24, 40, 88]))}{d(1)}",
        lambda: f"{r.choice(['token', w()])} {r.choice(['sk', 'ghp', 'pat'])}_{b(r.randint(24, 40))}{d(1)}",
    ]
    no = [
        lambda: f"{w()} at {w()} dot {w()}",
        lambda: f"{w()} {r.choice(['at noon', 'meet'])} at {w()}. {w()}",
        lambda: f"{w()} {w()} at {w()}. {w().title()} {w()}",
        lambda: f"{r.choice(['order', 'invoice', 'part no'])} {d(r.randint(7, 14))}",
        lambda: f"{r.choice(['order', w(), 'serial'])} {d(r.randint(7, 19))}",
        lambda: f"{r.choice(['year', w(), 'version'])} {r.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}",
        lambda: f"{r.choice(['year', w()])} {d(2)}.{d(2)}.{r.randint(1900, 2030)}",
        lambda: f"{r.choice(['isbn', w()])} 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{r.choice(['total', 'population', w()])} {d(1)} {d(3)} {d(3)} {d(3)}",
        lambda: f"{w()} {d(2)}.{d(1)} {d(2)}.{d(1)} {d(2)}.{d(1)} {d(2)}.{d(1)}",
        lambda: f"{r.choice(['total', w()])} {' '.join(d(r.randint(1, 4)) for _ in range(r.randint(5, 30)))}",
        lambda: f"{w()} {d(r.randint(20, 80))}",
        lambda: f"{w()} {r.choice(['', 'and '])}{d(16)} {w()}",
        lambda: f"{r.choice(['serial', 'order'])} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['version', 'chapter', w()])} {d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(1)}",
        lambda: f"{w()} {w()}{w()}{w()}{w()}{w()}{w()}",
        lambda: f"{w()} {w()}-{w()}-{w()}-{w()}-{w()}-{w()}",
        lambda: f"{w()} {w()}/{w()}/{w()}/{w()}{d(1)}/{w()}",
        lambda: f"{w()} {w().upper()}{w().upper()}{w().upper()}{w().upper()}{w().upper()}",
        lambda: f"{w()} ref DA{d(2)} {u(4)} {u(4)} {u(4)}",
        lambda: f"{r.choice(['batch', 'model'])} XK{d(2)}{u(12)}",
        lambda: f"lot AB{d(2)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['model', 'ref'])} QT{d(2)}{d(4)}{d(4)}{d(4)}{d(4)}",
        lambda: f"{r.choice(['order', 'invoice', 'batch'])} {d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{r.choice(['part no', 'model'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{w()} token: {w()}",
        lambda: f"{w()} secret: {w()}",
        lambda: f"{w()} {w()}_{w()}_{w()}_{w()}_{w()}",
        lambda: f"{w()} {w()}_{w()}_{d(2)}_{w()}_{w()}",
        lambda: f"{w()} {'=' * r.randint(2, 9)}{'-' * r.randint(16, 60)}",
    ]
    return [
        {"text": make(), "real": float(k < len(yes)), "form": k} for _ in range(copies) for k, make in enumerate(yes + no)
    ]


class PiiModel:
    """Trees over candidate features, and for each kind the least log odds to report."""

    def __init__(self, forest: gbdt.Forest, thresholds: list[float]):
        self.forest, self.thresholds = forest, thresholds


def train_pii(spark: SparkSession, precision: float = 0.98, trees: int = 32, depth: int = 3, folds: int = 6) -> PiiModel:
    """Fit the trees on made-up examples (a fixed, small number) and calibrate.

    The thresholds are set on margins from trees that never saw the example's form: the
    templates are dealt to ``folds`` parts, and each part is judged by trees grown on the
    others. Each kind gets the lowest threshold at which at least ``precision`` of what is
    reported is real. A kind that never reaches it reports nothing.
    """
    fields = "array<struct<text:string,real:double,form:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(_examples())), fields)).alias("e"))
    rows = rows.select("e.*", F.explode(candidates(F.col("e.text"))).alias("c"))
    rows = rows.select(
        "text", "real", "form", F.expr(f"{SPAN_KIND} AS kind"), *[F.col("c")[f].alias(f) for f in FEATURES]
    )
    got = [tuple(r) for r in rows.orderBy("text", "generator", *FEATURES).collect()]
    x = np.array([g[4:] for g in got], float)
    y, form, kind = (np.array([g[k] for g in got]) for k in (1, 2, 3))
    grow = lambda rows: gbdt.fit(x[rows], y[rows], trees=trees, depth=depth, rate=0.3, least_rows=5)
    margin = np.zeros(len(y))
    for fold in range(folds):
        mine = form % folds == fold
        margin[mine] = grow(~mine).margin(x[mine])
    thresholds = []
    for k in range(len(KINDS)):
        m, real = margin[kind == k], y[kind == k]
        order = np.argsort(-m, kind="stable")
        kept = np.cumsum(real[order]) / np.arange(1, len(order) + 1) >= precision
        last = np.append(m[order][1:] < m[order][:-1], True) if len(order) else np.zeros(0, bool)  # ties go together
        good = np.flatnonzero(kept & last)
        thresholds.append(float(m[order][good[-1]]) if len(good) else float("inf"))
    return PiiModel(grow(np.ones(len(y), bool)), thresholds)


def added_spans(found: str, model: PiiModel) -> Column:
    """Of the candidates in column ``found`` those that the trees accept, as (start, place of the kind, end)."""
    limits = ", ".join(f"{min(t, 1e9):.17g}D" for t in model.thresholds)
    return F.expr(f"""transform(
        filter(
          transform({found}, c -> struct(c.start, {SPAN_KIND} AS kind_at, c.end, {tree_margin(model.forest, "c")} AS margin)),
          c -> c.margin >= array({limits})[c.kind_at]),
        c -> struct(c.start, c.kind_at, c.end))""")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind_at"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_pii(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans``, ``all_spans`` (arrays of start, kind_at, end),
    ``n_<kind>`` of each base kind, ``n_added``, ``n_spans`` and ``spans``, all spans as
    kind:start:end.

    Base spans always stay; the trees only add. An added span that lies inside another
    span is left out, whatever the kinds. Places are code points, ends are exclusive. A
    null text counts as empty: no spans; texts are searched whole, however long. Added
    columns replace input columns of the same names; rows are independent, so repeats get
    equal results and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({"base_spans": base_spans(text), "_pii_found": candidates(text)})
    found = found.withColumn("_pii_added", added_spans("_pii_found", model))
    # In order of start, the longer first, base spans before added ones of the same place.
    ranked = lambda column, added: F.transform(
        column,
        lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(added).alias("added"), s["kind_at"].alias("kind_at")
        ),
    )
    merged = F.array_sort(F.concat(ranked("base_spans", 0), ranked("_pii_added", 1)))
    found = found.withColumn("_pii_all", F.when(F.size("_pii_added") > 0, merged))
    reach = running(F.transform("_pii_all", lambda s: -s["back"]), lambda a, b: F.greatest(a, b), F.lit(0))
    found = found.withColumn("_pii_reach", F.when(F.size("_pii_all") > 0, reach))
    before = lambda i: F.coalesce(F.get(F.col("_pii_reach"), i - 1), F.lit(0))
    kept = F.filter("_pii_all", lambda s, i: (s["added"] == 0) | (-s["back"] > before(i)))
    kept = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind_at"].alias("kind_at"), (-s["back"]).alias("end")))
    found = found.withColumn("all_spans", F.coalesce(F.array_sort(kept), F.col("base_spans")))
    count = lambda at: F.size(F.filter("base_spans", lambda s: s["kind_at"] == at)).cast("long")
    counts = {f"n_{kind}": count(at) for at, kind in enumerate(BASE_KINDS)}
    counts["n_spans"] = F.size("all_spans").cast("long")
    counts["n_added"] = (F.size("all_spans") - F.size("base_spans")).cast("long")
    dropped = ("_pii_found", "_pii_added", "_pii_all", "_pii_reach")
    return found.withColumns(counts | {"spans": _listed(F.col("all_spans"))}).drop(*dropped)


def base_digest(spans: str = "base_spans") -> Column:
    return F.sha2(_listed(F.col(spans)), 256)


def redact(found: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace what ``all_spans`` covers by ``mark``; spans that overlap share one."""
    text, spans = F.col(text_col), F.col("all_spans")
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    found = found.withColumn("_pii_reach", F.when(F.size(spans) > 0, reach).otherwise(_none("int")))
    done = lambda i: F.coalesce(F.get(F.col("_pii_reach"), i - 1), F.lit(0))
    parts = F.transform(
        spans,
        lambda s, i: F.when(
            (i == 0) | (s["start"] >= done(i)),
            F.concat(F.substring(text, done(i) + 1, F.greatest(s["start"] - done(i), F.lit(0))), F.lit(mark)),
        ).otherwise(F.lit("")),
    )
    rest = F.substring(text, F.element_at("_pii_reach", -1) + 1, F.length(text))
    cut = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    return found.withColumn(text_col, cut).drop("_pii_reach")
