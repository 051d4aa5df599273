"""Personal data: native candidate generators, boosted trees, calibrated selection.

Four base kinds (email, ip, card, phone) are found by their patterns and checks and
always stay. High-recall generators propose further, overlapping spans: runs of digits,
the shapes of local phone and security numbers wherever one can start in a run, long
tokens with a digit, and masked addresses; of a run or token that touches base spans,
what is left between them. Each candidate's format and context become features; boosted
trees give a calibrated probability, and those at or above the threshold that reached
the wanted precision on calibration rows are added unless they overlap a base span. Of those
that overlap each other, in reading order, the next one takes the place of the one before it
if it is likelier (equal ones: the earlier, then the longer); a second reading adds those
that overlap no addition of the first.

Everything on a text is a DataFrame expression; the trees are nested CASE expressions.
The trees are fitted on the driver from examples that ``examples()`` writes, whose
features are computed by the same expressions: the tables hold no labels of personal data,
so thresholds are calibrated on written examples, not on the corpus.

Patterns are those of the task with possessive quantifiers and a start condition that
change no match but keep time linear: a run can only start where no member of it stands
before, or where the last match ended.

Nothing is capped. Arrays of spans are walked by chunks of ``CHUNK``, so the work on a text
grows about in proportion to its matches, and a very long text is held in one task.

Null and empty texts have no spans; rows and ids are never joined, so repeated rows and
clashing column names are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

#: Base kinds in their order of rank, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "masked")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?=\(?[0-9][0-9 ().-]{5})\(?[0-9](?:[ ().-]*+[0-9])*+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "masked": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++",
}
#: Shapes of numbers, proposed wherever they can start: group 1 is the shape, group 2 what
#: follows, and the match itself only the first character, so that matches may overlap.
INNER = {k: rf"(?<![0-9])(?=({shape})(?![0-9])((?s:.{{0,4}})))[0-9(]" for k, shape in {
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}",
}.items()}
#: What a candidate cut at base spans must still be.
REST = {"number": r"\(?[0-9](?:[ ().-]*+[0-9])*+", "secret": "[A-Za-z0-9_+/=-]{16,}+"}
#: What a text must have for a kind to be possible; most texts have none.
_GATES = {"email": "@", "phone": "+", "ip": "[0-9]", "card": "[0-9]", "number": "[0-9]", "secret": "[0-9]", "masked": r"(?i)[\[(]at[\])]"}

_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements of an array, and characters of a text, that are walked at a time.
CHUNK, TEXT_CHUNK = 256, 4096


def _chunks(a: Column) -> Column:
    last = F.floor((F.size(a) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(a, i * CHUNK + 1, CHUNK))


def _scan(a: Column, state: Column, none: Column, step) -> Column:
    """What ``step(state, element)`` emits, in one walk: it returns the next state and an array."""

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def chunk(acc: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    return F.aggregate(_chunks(a), F.struct(state.alias("state"), none.alias("out")), chunk)["out"]


def _emit(state: Column, out: Column) -> Column:
    return F.struct(state.alias("state"), out.alias("out"))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text that _blocks() cut; does not walk the text from its start."""
    first = F.floor(start / TEXT_CHUNK).cast("int")
    n = F.floor((end - 1) / TEXT_CHUNK).cast("int") - first + 1
    return F.when(end <= start, "").otherwise(F.substr(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), ""), start % TEXT_CHUNK + 1, end - start))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))


def _span(start: Column, end: Column, m: Column, before: Column, after: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), m.alias("m"), before.alias("before"), after.alias("after"))


def find(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern with code-point offsets and what stands around them."""
    pattern, gate = PATTERNS[kind], _GATES[kind]
    none = F.array().cast(_SPAN)

    def walk(x: Column) -> Column:
        pieces = F.arrays_zip(x["m"], x["s"], F.slice(x["s"], 2, 2**31 - 1).alias("n"))

        def step(at: Column, p: Column) -> Column:
            begin = at + F.length(p["s"])
            end = begin + F.length(p["m"])
            span = _span(begin, end, p["m"], F.right(p["s"], F.lit(24)), F.left(p["n"], F.lit(4)))
            return F.when(p["m"].isNull(), _emit(at, none)).otherwise(_emit(end, F.array(span)))

        return _scan(pieces, F.lit(0), none, step)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))
    possible = F.instr(text, gate) > 0 if len(gate) == 1 else text.rlike(gate)
    return F.when(possible, _let(both, walk)).otherwise(none)


def find_inner(text: Column, shape: str) -> Column:
    """find() for the overlapping matches of a shape of INNER."""
    pattern = INNER[shape]
    none = F.array().cast(_SPAN)

    def walk(x: Column) -> Column:
        pieces = F.arrays_zip(x["m"], x["after"], x["s"])

        def step(s: Column, p: Column) -> Column:
            begin = s["at"] + F.length(p["s"])
            before = F.right(F.concat(s["tail"], p["s"]), F.lit(24))
            span = _span(begin, begin + F.length(p["m"]), p["m"], before, p["after"])
            follows = F.struct((begin + 1).alias("at"), F.concat(before, F.left(p["m"], F.lit(1))).alias("tail"))
            return F.when(p["m"].isNull(), _emit(s, none)).otherwise(_emit(follows, F.array(span)))

        return _scan(pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), none, step)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("after"), F.split(text, pattern, -1).alias("s"))
    return F.when(text.rlike(pattern), _let(parts, walk)).otherwise(none)


def rest(c: Column, taken: Column, kind: str) -> Column:
    """The candidates that are left of ``c`` between the ``taken`` spans, sorted by start."""
    none = F.array().cast(_SPAN)
    end = F.array(F.struct(c["end"].alias("start"), c["end"].alias("end")))
    stops = F.concat(F.transform(F.filter(taken, lambda b: _overlaps(b, c)), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), end)

    def cut_at(blocks: Column) -> Column:
        size = c["end"] - c["start"]

        def step(at: Column, b: Column) -> Column:
            def cut(gap: Column) -> Column:
                def one(m: Column) -> Column:
                    skip = at + F.instr(gap, m) - 1 - c["start"]
                    to = skip + F.length(m)
                    before = F.right(F.concat(c["before"], _cut(blocks, F.greatest(skip - 24, F.lit(0)), skip)), F.lit(24))
                    after = F.left(F.concat(_cut(blocks, to, F.least(to + 4, size)), c["after"]), F.lit(4))
                    return _span(c["start"] + skip, c["start"] + to, m, before, after)

                found = F.slice(F.regexp_extract_all(gap, F.lit(REST[kind]), F.lit(0)), 1, 1)
                return _emit(F.greatest(at, b["end"]), F.transform(found, one))

            return _let(_cut(blocks, at - c["start"], F.greatest(b["start"], at) - c["start"]), cut)

        return _scan(stops, c["start"], none, step)

    return _let(_blocks(c["m"]), cut_at)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The check of a base kind's match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return _let(_digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    return F.length(_digits(m)).between(9, 15)


def features(c: Column) -> dict[str, Column]:
    """Format and context figures of a candidate with fields m, before, after."""
    m, before = c["m"], c["before"]

    def count(pattern: str) -> Column:
        return F.regexp_count(m, F.lit(pattern)).cast("double")

    def flag(x: Column) -> Column:
        return F.coalesce(x, F.lit(False)).cast("double")

    return {
        "length": F.length(m).cast("double"),
        "digits": count("[0-9]"),
        "upper": count("[A-Z]"),
        "lower": count("[a-z]"),
        "marks": count("[^A-Za-z0-9]"),
        "groups": count("[A-Za-z0-9]+"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "hex": flag(m.rlike("^[0-9a-f]+$")),
        "key_id": flag(m.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[bp]-|AIza)[A-Za-z0-9_-]{12,}$")),
        "account": flag(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")),
        "ssn": flag(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "local": flag(m.rlike(r"^\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}$")),
        "date": flag(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}")),
        "set_to": flag(before.rlike("[=:] ?[\"']?$")),
        "says_secret": flag(before.rlike(r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|credential)\W*\w*\W{0,4}$")),
        "says_phone": flag(before.rlike(r"(?i)(?:tel|phone|call|mobile|fax|cell)\W*\w{0,8}\W{0,4}$")),
        "says_id": flag(before.rlike(r"(?i)(?:ssn|social security|tax id|passport|iban|account)\W*\w{0,8}\W{0,4}$")),
        "glued": flag(before.rlike("[A-Za-z0-9+@/.]$") | c["after"].rlike("^[A-Za-z0-9@]")),
    }


def examples(kind: str, n: int = 1200, seed: int = 17) -> list[dict]:
    """Written candidates of a generator with y 1 for personal data or a secret, 0 for a decoy."""
    r = random.Random(seed)
    words = ["the", "of", "plan", "see", "in", "value", "total", "was", "der", "les", "para", "unit", "route", "about"]

    def text(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    d, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = lambda: " ".join(r.choices(words, k=3)) + " "
    out = []
    for k in range(n):
        y = k % 2
        before, after = plain(), r.choice([" ", ".", ",", "\n", ""])
        if kind == "number":
            if y:
                shape = r.randrange(3)
                m = [f"({text(d, 3)}) {text(d, 3)}-{text(d, 4)}", f"{text(d, 3)}-{text(d, 3)}-{text(d, 4)}", f"{text(d, 3)}-{text(d, 2)}-{text(d, 4)}"][shape]
                before += r.choice(["", "phone ", "call ", "tel: "]) if shape < 2 else r.choice(["", "SSN ", "ssn: "])
            else:
                m = r.choice([f"{text('12', 1)}0{text(d, 2)}-{text('01', 1)}{text(d, 1)}-{text('012', 1)}{text(d, 1)}", f"{text(d, 1)} {text(d, 3)} {text(d, 3)}", text(d, r.randrange(7, 20)), f"{text(d, 2)}.{text(d, 2)}.20{text(d, 2)}", f"{text(d, 4)} - {text(d, 4)}", f"{text(d, 3)}.{text(d, 6)}", " ".join(text(d, 2) for _ in range(5)), f"{text(d, 2)}.{text(d, 2)}.{text(d, 3)}.{text(d, 2)}", f"{text(d, 4)} {text(d, 4)} {text(d, 4)} {text(d, 4)}"])
                before += r.choice(["", "", "€", "no. ", "v"])
        elif kind == "secret":
            if y:
                shape = r.randrange(4)
                m = [text("0123456789abcdef", r.choice([32, 40, 64])), "AKIA" + text(up + d, 16), text(low + up + d, r.randrange(20, 50)), r.choice(["ghp_", "sk-"]) + text(low + up + d, 36)][shape]
                if shape in (0, 2):
                    before += r.choice(['token = "', "api_key: ", "secret=", "password: ", "Authorization: Bearer ", 'auth_token="'])
            else:
                m = r.choice(["_".join(r.choices(words, k=4)) + f"_{text(d, 2)}", "-".join(r.choices(words, k=4)) + f"-{text(d, 4)}", f"20{text(d, 2)}-{text(d, 2)}-{text(d, 2)}T{text(d, 6)}", text(d, r.randrange(16, 24)), text("0123456789abcdef", 40), "/".join(r.choices(words, k=5)) + f"/{text(d, 2)}", "=" * 20 + text(d, 1), text(low, 18) + text(d, 1)])
                before += r.choice(["", "", "commit ", "sha1 ", "file "])
        else:
            name = text(low, r.randrange(3, 9))
            if y:
                m = f"{name} {r.choice('[(')}at{r.choice('])')} {text(low, 6)} {r.choice(['[dot]', '(dot)', '.'])} {r.choice(['com', 'org', 'net', 'de'])}"
                m = m.replace(" ", r.choice(["", " "]))
            else:
                m = f"{name} (at) {r.choice(words)}. {text(low, r.randrange(6, 12))} . {text(low, r.randrange(5, 12))}"
        out.append({"m": m, "before": before[-24:], "after": after, "y": y})
    return out


@lru_cache(maxsize=8)
def _fitted(spark: SparkSession, kind: str) -> boosting.Boosted:
    shape = "array<struct<m:string,before:string,after:string,y:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(kind))), shape)).alias("c"))
    named = features(F.col("c"))
    got = rows.select(*[v.alias(k) for k, v in named.items()], F.col("c.y").alias("y")).collect()
    x = np.array([list(r)[:-1] for r in got], float)
    return boosting.fit(list(named), x, np.array([r["y"] for r in got], float))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _flagged(events: Column, first: int, flag, after) -> Column:
    """Walk ``events`` and emit (i, hit) for those with i >= 0; state: what ``after`` made of the others."""
    none = F.array().cast("array<struct<i:int,hit:boolean>>")

    def step(state: Column, e: Column) -> Column:
        return F.when(e["i"] < 0, _emit(after(state, e), none)).otherwise(_emit(state, F.array(F.struct(e["i"].alias("i"), flag(state, e).alias("hit")))))

    return _scan(events, F.lit(first), none, step)


_EVENT = "struct<start:int,i:int,end:int>"
_FAR = 2**31 - 1


def beside(spans: Column, taken: Column) -> Column:
    """(i, touched, covered) of the spans sorted by place: whether ``taken`` spans overlap or cover them."""
    events = F.concat(
        F.transform(taken, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("i"), b["end"].alias("end")).cast(_EVENT)),
        F.transform(spans, lambda c, i: F.struct(c["start"].alias("start"), i.alias("i"), c["end"].alias("end")).cast(_EVENT)),
    )

    def walk(e: Column) -> Column:
        until = lambda state, b: F.greatest(state, b["end"])
        covered = _flagged(e, 0, lambda state, c: state >= c["end"], until)
        left = _flagged(e, 0, lambda state, c: state > c["start"], until)
        right = F.reverse(_flagged(F.reverse(e), _FAR, lambda state, c: state < c["end"], lambda state, b: b["start"]))
        return F.transform(F.arrays_zip(left.alias("l"), right.alias("r"), covered.alias("c")), lambda z: F.struct(z["l"]["i"].alias("i"), (z["l"]["hit"] | z["r"]["hit"]).alias("touched"), z["c"]["hit"].alias("covered")))

    return _let(F.sort_array(events), walk)


def _near(spans: Column, chunk: Column) -> Column:
    """The spans that lie between the first start and the last end of a chunk sorted by place."""
    top = F.array_max(F.transform(chunk, lambda c: c["end"]))
    return _let(F.struct(chunk[0]["start"].alias("start"), top.alias("end")), lambda r: F.filter(spans, lambda o: _overlaps(o, r)))


_RATED = "struct<start:int,end:int,p:double,rank:int,kind:string>"


def _winners(spans: Column) -> Column:
    """Disjoint ones of the spans sorted by place: each next span takes the place of the one
    that it overlaps if it is likelier, or goes."""
    none = F.array().cast(f"array<{_RATED}>")
    nothing, end = (F.struct(F.lit(k), F.lit(k), F.lit(0.0), F.lit(0), F.lit("")).cast(_RATED) for k in (-1, _FAR))

    def step(best: Column, c: Column) -> Column:
        better = F.struct(c["p"], c["start"], -c["end"]) < F.struct(best["p"], best["start"], -best["end"])
        stays = F.when(best["start"] < 0, none).otherwise(F.array(best))
        return F.when(c["start"] >= best["end"], _emit(c, stays)).when(better, _emit(c, none)).otherwise(_emit(best, none))

    return _scan(F.concat(spans, F.array(end)), nothing, none, step)


def select_spans(rated: Column) -> Column:
    """The additions, from spans (start, end, p, rank, kind) with p the negative probability."""
    own = F.sort_array(F.transform(rated, lambda c: c.cast(_RATED)))

    def more(x: Column) -> Column:
        free = F.filter(beside(x["own"], x["won"]), lambda f: ~f["touched"])
        return F.concat(x["won"], _let(F.sort_array(F.transform(free, lambda f: x["own"][f["i"]])), _winners))

    def choose(spans: Column) -> Column:
        first = F.struct(spans.alias("own"), _winners(spans).alias("won"))
        return _let(first, lambda x: F.when(F.size(x["won"]) == F.size(spans), x["won"]).otherwise(more(x)))

    return F.when(F.size(rated) < 2, rated).otherwise(_let(own, choose))


def detect(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with pii_base and pii_spans, sorted arrays of (start, end, rank, kind).

    Columns of those names are replaced.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = documents.drop("pii_base", "pii_spans").withColumns({f"__{k}": find(text, k) for k in PATTERNS} | {f"__{k}": find_inner(text, k) for k in INNER})

    def plain(c: Column, kind: str) -> Column:
        rank = (*BASE, *ADDED).index(kind)
        return F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end"), F.lit(kind).alias("kind"))

    def checked(kind: str) -> Column:
        return F.transform(F.filter(F.col(f"__{kind}"), lambda c: valid(kind, c["m"])), lambda c: plain(c, kind))

    base = F.sort_array(F.concat(*[checked(k) for k in BASE]))
    found = found.withColumn("pii_base", base)

    taken = F.col("pii_base")

    def free(kind: str, name: str) -> Column:
        """Proposed spans that no base span overlaps, and what is left of the others between base spans."""
        proposed = F.col(f"__{name}")

        def parts(flags: Column) -> Column:
            whole = F.transform(F.filter(flags, lambda f: ~f["touched"]), lambda f: proposed[f["i"]])
            if kind != name or kind not in REST:
                return whole
            cut = F.transform(F.filter(flags, lambda f: f["touched"] & ~f["covered"]), lambda f: proposed[f["i"]])

            def chunk(ch: Column) -> Column:
                return _let(_near(taken, ch), lambda near: F.flatten(F.transform(ch, lambda c: rest(c, near, kind))))

            return F.concat(whole, _let(cut, lambda c: F.when(F.size(c) == 0, F.array().cast(_SPAN)).otherwise(F.flatten(F.transform(_chunks(c), chunk)))))

        return F.when((F.size(taken) == 0) | (F.size(proposed) == 0), proposed).otherwise(_let(beside(proposed, taken), parts))

    def scored(kind: str) -> Column:
        model = _fitted(spark, kind)
        spans = free(kind, kind)
        if kind == "number":
            spans = F.concat(F.filter(spans, lambda c: F.length(c["m"]) >= 7), *[free(kind, k) for k in INNER])
        if kind == "secret":
            spans = F.filter(spans, lambda c: c["m"].rlike("[0-9]"))
        rank = ADDED.index(kind) + len(BASE)
        rated = F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), (-model.column(features(c))).alias("p"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
        return F.filter(rated, lambda c: c["p"] <= -model.threshold)

    found = found.withColumn("__rated", F.concat(*[scored(k) for k in ADDED]))
    added = F.transform(select_spans(F.col("__rated")), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    found = found.withColumn("pii_spans", F.sort_array(F.concat("pii_base", added)))
    return found.drop("__rated", *[f"__{k}" for k in (*PATTERNS, *INNER)])


def number_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with every span of ``text_col`` replaced by [KIND]; all columns stay.

    Overlapping spans are replaced as one, under the kind of the first. Null texts stay null.
    """
    found = detect(documents.withColumn("__text", F.col(text_col)), "__text")
    text = F.col("__text")
    none = F.array().cast("array<string>")

    def clean(blocks: Column) -> Column:
        def step(at: Column, c: Column) -> Column:
            pieces = F.array(_cut(blocks, at, F.greatest(c["start"], at)), F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]")))
            return F.when(c["start"] >= at, _emit(c["end"], pieces)).otherwise(_emit(F.greatest(at, c["end"]), none))

        last = F.array_max(F.transform(F.col("pii_spans"), lambda c: c["end"]))
        pieces = _scan(F.col("pii_spans"), F.lit(0), none, step)
        return F.array_join(F.concat(pieces, F.array(_cut(blocks, last, F.length(text)))), "")

    done = F.when(F.size("pii_spans") > 0, _let(_blocks(text), clean)).otherwise(text)
    return found.withColumn(text_col, done).select(*documents.columns)
