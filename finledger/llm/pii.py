"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern of typed alternatives.  An entity's identity
is (type, normal form): e-mail addresses in lower case, phone numbers by their
last ten digits, cards by their digits, persons by title gender and lower-case
name.  A surrogate is a keyed hash (SHA-256) of the identity laid over the
entity's own shape: digits become digits, letters become letters of the same
case and script, separators and titles stay.  E-mail domains end in a reserved
name, addresses go to the reserved block 240/4, cards keep their first digit
and Luhn validity, phone numbers keep their country code, and persons get names
with the ending of their gender.  So the same entity has the same surrogate in
all documents (coreference), whatever its spelling.

Collision checks: surrogates of all distinct entities are compared with each
other and with all real entities.  Who shares one is drawn again with the next
round's key, smallest identity first, until nothing collides; from round
``LONGER`` on addresses and names grow by a letter or syllable a round, so that
short ones never run out.  Distinct entities never share a surrogate.  Redrawn entities are rare;
they reach the documents by a join on the document, all others are
computed in place, without a shuffle of texts.

Defined results: null texts stay null; texts without entities stay as they are;
entities that overlap count once, leftmost first; equal rows get equal texts;
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LONGER = 3
# fixed values: a capitalised word of a name, and all that follow it
WORD = r"(?:\p{Lu}['’])?+\p{Lu}\p{L}++(?:['’]\p{Lu}\p{L}++)?"
NAMES = f"{WORD}(?:[ -]{WORD})*+"
# fixed values: what the detector knows, one alternative for each type, most specific first
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "aws": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"\b(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}(?=\S*[0-9@!#$%&*+/=_~^])(?:\"[^\s\"]{8,}+|'[^\s']{8,}+|[^\s\"']{8,}+)",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})(?![\w:])",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b",
    "woman": r"\b(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа)\.? " + NAMES,
    "person": r"\b(?:Dr|Prof|Doctor|Professor|Doktor)\.? " + NAMES,
    "man": r"\b(?:Mr|Herr|Monsieur|Señor|Sr|Г-н)\.? " + NAMES,
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
_HEX = "0123456789abcdef"
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщьыз"
#: 40 syllables of two letters
_SYLLABLES = "".join(a + b for a in "bdklmnrstv" for b in "aeio")


SECRET_NAME = r"^[^=:]*[=:]\s{0,3}[\"']?"
#: signs at a secret's end may belong to the sentence: they stay, and are no part of its identity
SECRET_END = r"[.,;:!?)\]}>]*+$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entity_type(m: Column) -> Column:
    """The type of a found entity, by its shape."""
    kind = F.when(m.contains("@") & m.rlike(f"^(?:{TYPES['email']})$"), "email")
    for t in ("aws", "iban", "ip6", "ip", "ssn", "phone", "card", "woman", "person", "man"):
        kind = kind.when(m.rlike(f"^(?:{TYPES[t]})$"), t)
    return kind.otherwise("secret")


def normal(kind: Column, m: Column) -> Column:
    """The identity of an entity within its type."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.lower(F.regexp_replace(m, r"^\S+ ", ""))
    return (F.when(kind == "email", F.lower(m)).when(kind == "phone", F.right(digits, F.lit(10)))
            .when(kind == "card", digits).when(kind == "iban", F.regexp_replace(m, " ", ""))
            .when(kind.isin("woman", "man", "person"), name).when(kind == "ip6", F.lower(m))
            .when(kind == "secret", F.regexp_replace(F.regexp_replace(m, SECRET_NAME, ""), SECRET_END, "")).otherwise(m))


def _stream(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """256 keyed hex digits for an identity and a draw."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, norm, draw.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{i}")), 256) for i in range(4)])


def _pick(stream: Column, k: Column, n: int) -> Column:
    """Number k (0 to 127) of the stream, below n."""
    pair = F.substr(stream, (F.pmod(k, F.lit(128)) * 2 + 1).cast("int"), F.lit(2))
    return F.pmod(F.conv(pair, 16, 10).cast("int"), F.lit(n))


def _letter(alphabet: str, at: Column) -> Column:
    return F.substr(F.lit(alphabet), at + 1, F.lit(1))


def _reshape(m: Column, stream: Column, hexadecimal: Column, keep_from: Column) -> Column:
    """The entity's shape filled from the stream, right to left; after ``keep_from`` digits or letters the rest stays."""

    def step(s: Column, c: Column) -> Column:
        k = s["k"]
        digit, low, high = c.rlike("[0-9]"), c.rlike(r"[a-z]"), c.rlike(r"[A-Z]")
        cyr_low, cyr_high = c.rlike(r"[а-я]"), c.rlike(r"[А-Я]")
        latin = F.when(hexadecimal, _letter("abcdef", _pick(stream, k, 6))).otherwise(_letter(_LATIN, _pick(stream, k, 26)))
        cyrillic = _letter(_CYRILLIC, _pick(stream, k, 26))
        new = (F.when(k >= keep_from, c).when(digit, _pick(stream, k, 10).cast("string")).when(low, latin)
               .when(high, F.upper(latin)).when(cyr_low, cyrillic).when(cyr_high, F.upper(cyrillic)).otherwise(c))
        used = (digit | low | high | cyr_low | cyr_high).cast("int")
        return F.struct(F.concat(new, s["out"]).alias("out"), (k + used).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(F.reverse(m), ""), start, step, lambda s: s["out"])


def _secret(norm: Column, stream: Column) -> Column:
    """A secret's shape filled from the stream, in time linear in its length; letters of other scripts become Latin ones."""
    hexadecimal = norm.rlike("^[0-9a-f]+$")

    def char(c: Column, i: Column) -> Column:
        latin = F.when(hexadecimal, _letter("abcdef", _pick(stream, i, 6))).otherwise(_letter(_LATIN, _pick(stream, i, 26)))
        return (F.when(c.rlike("[0-9]"), _pick(stream, i, 10).cast("string")).when(c.rlike("[A-Z]"), F.upper(latin))
                .when(c.rlike(r"[a-z]|[^\x00-\x7F]"), latin).otherwise(c))

    return F.array_join(F.transform(F.split(norm, ""), char), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number, its last digit counted once."""
    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + F.pmod(s["i"], F.lit(2)))
        return F.struct((s["t"] + d - F.when(d > 9, 9).otherwise(0)).alias("t"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), add, lambda s: s["t"])


def _syllable(stream: Column, at: Column) -> Column:
    return F.substr(F.lit(_SYLLABLES), _pick(stream, at, 40) * 2 + 1, F.lit(2))


def _name(m: Column, stream: Column, ending: Column, more: Column) -> Column:
    """Title, then as many names of keyed syllables as the entity has, in its script."""
    def word(at: Column, syllables_of: int, last: Column) -> Column:
        return F.initcap(F.concat(*[_syllable(stream, at + i) for i in range(syllables_of)], last))

    title, rest = F.regexp_extract(m, r"^(\S+ )", 1), F.regexp_replace(m, r"^\S+ ", "")
    # the last name stands at 8 of the stream, the first at 0, those between from 12 on
    between = F.regexp_extract_all(rest, F.lit(r"[ -]"), F.lit(0))
    given = F.transform(between, lambda sign, i: F.concat(word(F.when(i == 0, 0).otherwise(8 + 4 * i), 3, ending), sign))
    # each further round adds a syllable to the last name
    longer = F.array_join(F.transform(F.slice(F.sequence(F.lit(40), F.lit(100)), F.lit(1), more), lambda at: _syllable(stream, at)), "")
    latin = F.concat(F.array_join(given, ""), F.concat(word(F.lit(8), 4, F.lit("")), longer, F.lit("s")))

    def in_script(name: Column) -> Column:
        cyrillic = F.translate(name, _LATIN + _LATIN.upper(), _CYRILLIC + _CYRILLIC.upper())
        return F.when(rest.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(name)

    return let(let(latin, in_script), lambda name: F.concat(title, F.when(rest == F.upper(rest), F.upper(name)).otherwise(name)))


def surrogate(key: str, m: Column, kind: Column, draw: Column) -> Column:
    """The entity's replacement; type, identity and keyed digits are computed once."""
    known = F.struct(m.alias("m"), kind.alias("kind"))
    return let(known, lambda a: let(F.struct(a["m"].alias("m"), a["kind"].alias("kind"), normal(a["kind"], a["m"]).alias("norm")), lambda b: let(
        F.struct(b["m"].alias("m"), b["kind"].alias("kind"), b["norm"].alias("norm"), _stream(key, b["kind"], b["norm"], draw).alias("s")),
        lambda v: _laid_over(v["m"], v["kind"], v["norm"], v["s"], F.least(F.greatest(draw - (LONGER - 1), F.lit(0)), F.lit(60))))))


def _laid_over(m: Column, kind: Column, norm: Column, s: Column, more: Column) -> Column:
    """``more``: letters or syllables that a late draw adds.

    Types share one reshaping and one name: a copy for each would make plans
    that the driver cannot hold many of.
    """
    never = F.lit(False)
    every = F.lit(1 << 20)
    named = kind.isin("woman", "person", "man")
    local, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    label = F.substring_index(host, ".", 1)
    digits = F.regexp_replace(m, "[^0-9]", "")
    # what is reshaped of each type; null: nothing
    part = (F.when(named | kind.isin("ip", "secret"), None).when(kind == "email", F.concat(local, F.repeat(F.lit("a"), more)))
            .when(kind == "aws", F.substr(m, F.lit(5))).when(kind == "iban", F.substr(m, F.lit(3))).otherwise(m))
    keep_from = F.when(kind == "phone", 10).when(kind == "card", F.length(digits) - 1).otherwise(every)
    ip = F.concat_ws(".", (_pick(s, F.lit(0), 15) + 240).cast("string"),
                     *[_pick(s, F.lit(i), 256).cast("string") for i in (1, 2, 3)])

    def card(v: Column) -> Column:
        """v: digits, and the entity reshaped with its first digit kept."""
        digits, drawn = v["digits"], v["drawn"]
        body = F.concat(F.substr(F.regexp_replace(drawn, "[^0-9]", ""), F.lit(1), F.length(digits) - 1), F.lit("0"))
        check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, F.concat(
            F.substr(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)

    ending = F.regexp_extract(F.regexp_replace(m, SECRET_NAME, ""), SECRET_END, 0)
    secret = F.concat(F.regexp_extract(m, SECRET_NAME, 0), _secret(norm, s), ending)
    name = _name(m, s, F.when(kind == "woman", "a").when(kind == "person", "e").otherwise("on"), more)

    def finished(drawn: Column) -> Column:
        email = F.concat(drawn, F.lit("@"),
                         let(F.substr(s, F.lit(129), F.lit(128)), lambda t: _reshape(label, t, never, every)), F.lit(".example.net"))
        cards = let(F.struct(digits.alias("digits"), drawn.alias("drawn")), card)
        return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", cards)
                .when(kind == "aws", F.concat(F.lit("AKIA"), drawn)).when(kind == "iban", F.concat(F.substr(m, F.lit(1), F.lit(2)), drawn))
                .when(named, name).when(kind == "secret", secret).otherwise(drawn))

    return let(_reshape(part, s, kind == "ip6", keep_from), finished)


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, draw of the entities whose first surrogate collides, and what they end with.

    ``found`` has kind, norm, m (a spelling).  Every round is a window over
    (kind, surrogate), whose groups are as small as chance makes them.
    """
    known = found.groupBy("kind", "norm").agg(F.min("m").alias("m"))
    known = staged(found.sparkSession, known, "entities")
    open_ = known.withColumn("draw", F.lit(0))
    taken = None
    for r in range(LONGER + 60):
        # the normal form names its value for each type: the surrogate must be in the plan once
        s = open_.withColumn("s", let(surrogate(key, F.col("m"), F.col("kind"), F.lit(r)), lambda v: normal(F.col("kind"), v)))
        first = F.row_number().over(Window.partitionBy("kind", "s").orderBy("norm")) == 1
        s = s.withColumn("ok", first)
        used = known.select("kind", F.col("norm").alias("s"))
        used = used if taken is None else used.union(taken)
        clash = s.join(used.distinct().withColumn("real", F.lit(True)), ["kind", "s"], "left")
        clash = staged(found.sparkSession, clash.withColumn("ok", F.col("ok") & F.col("real").isNull()), f"draw-{r}")
        good = clash.where("ok").select("kind", "s")
        taken = good if taken is None else taken.union(good)
        done = clash.where("ok").select("kind", "norm", F.lit(r).alias("draw"))
        out = done if r == 0 else out.union(done)
        open_ = clash.where(~F.col("ok")).select("kind", "norm", "m", F.lit(r + 1).alias("draw"))
        if open_.isEmpty():
            return out.where(F.col("draw") > 0)
    raise ValueError("surrogates still collide: widen the type's surrogate space")


#: what every alternative of a type needs; most texts hold none of it and skip the full pattern
HINT = r"[0-9][0-9.]|\b(?:Mrs?|Ms|Dr|Prof|Doctor|Professor|Doktor|Miss|Frau|Herr|Madame|Mme|Monsieur|Señora?|Sra?|Г-жа|Г-н)\b"


def entities(df: DataFrame, text: str = "text") -> Column:
    body = F.col(text).cast("string")
    hint = body.rlike(HINT)
    for sign in ("@", "=", ":", "AKIA", "ASIA"):
        hint = hint | F.contains(body, F.lit(sign))
    return F.when(hint, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its entities replaced, and ``__n``, their number in each row."""
    body = F.col(text).cast("string")
    row = F.xxhash64(body, F.lit(1))
    hits = df.select(row.alias("h"), F.octet_length(body).alias("n"), F.explode(F.array_distinct(entities(df, text))).alias("m"))
    hits = hits.withColumn("kind", entity_type(F.col("m")))
    hits = staged(df.sparkSession, hits.withColumn("norm", normal(F.col("kind"), F.col("m"))).distinct(), "found-entities")
    again = redrawn(hits.select("kind", "norm", "m"), key)
    # texts (by hash and length) that hold a redrawn entity: entity -> draw
    fix = hits.join(again, ["kind", "norm"]).groupBy("h", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("m", "draw"))).alias("__draws"))
    fix = staged(df.sparkSession, fix.select(F.col("h").alias("__h"), F.col("n").alias("__len"), "__draws"), "redrawn")
    rows = df.withColumn("__h", row).withColumn("__len", F.octet_length(body))
    # written first, so its size is known: broadcast below Spark's threshold, else a shuffle join
    rows = rows.join(fix, ["__h", "__len"], "left")

    def replaced(m: Column) -> Column:
        return surrogate(key, m, entity_type(m), F.coalesce(F.try_element_at(F.col("__draws"), m), F.lit(0)))

    def rebuilt(v: Column) -> Column:
        """v: text and its entities; with n entities there are n + 1 gaps."""
        new = F.array_append(F.transform(v["m"], replaced), F.lit(""))
        joined = F.array_join(F.zip_with(F.split(v["t"], ANY, -1), new, lambda gap, entity: F.concat(gap, entity)), "")
        return F.struct(F.when(F.size(v["m"]) > 0, joined).otherwise(v["t"]).alias("t"),
                        F.coalesce(F.when(v["t"].isNull(), 0).otherwise(F.size(v["m"])), F.lit(0)).alias("n"))

    rows = rows.withColumn("__r", let(F.struct(body.alias("t"), entities(df, text).alias("m")), rebuilt))
    rows = rows.withColumn(text, F.col("__r.t")).withColumn("__n", F.col("__r.n"))
    return rows.select(*df.columns, "__n")
