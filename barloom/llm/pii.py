"""Replacement of personal data by keyed surrogates of the same kind and form.

Entities are found by patterns and replaced within one projection of built-in
functions. A surrogate is a keyed permutation of the entity's own symbols: a
Feistel network whose halves are shifted symbol by symbol within their alphabet,
by a hash of the key, the kind and the other half. So it has the same form,
script and case; equal entities get equal surrogates everywhere, however they are
written; and different entities of a kind get different ones, since a
permutation maps no two values to one. Nothing has to be looked up or shared
between tasks, and a much repeated entity costs no shuffle.

`collisions` checks distinctness and coreference over all documents.

Names are found after a title or words of introduction. Every single name of them is
then also replaced wherever it stands in the same text as a word of its own, before or
after: a mention of the surname alone stays the mention of that person.

What each kind keeps: phones their country code and punctuation; cards their first
digit and whether the check digit is right; addresses a valid range; mail
addresses the top-level domain, reserved example domains, case and dots; names what
introduces them, particles, vowels where vowels were, consonants of a class that sounds alike,
and the last letter of each, so a surrogate can be spoken and is of the same gender;
secrets hexadecimal digits and case; keys their prefix, case and digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import free_name, staged
from barloom.llm.hilbert import _let

#: Fixed separators within a marked text; a text's own are escaped.
MARK, ESCAPE = "\u0001", "\u0002"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_OTHERS = ["àáâãäåæçèéêëìíîïðñòóôõö", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
ANY = [_LETTERS, _LETTERS.upper(), "0123456789", *_OTHERS, *(x.upper() for x in _OTHERS)]
DIGITS = ["0123456789"]
HEX = ["0123456789abcdef"]
#: Vowels, stops, liquids and nasals, hissing sounds, and the rest.
_SOUNDS = ["aeiou", "bdgkpt", "lmnr", "cfsvz", "hjqwxy"]
NAME = [*_SOUNDS, *(x.upper() for x in _SOUNDS), *_OTHERS, *(x.upper() for x in _OTHERS)]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Doña|Monsieur|Madame|Mme|Mlle|Госпожа|Господин|Κύριος|Κυρία"
_CUES = "[Mm]y name is|[Ii]ch heiße|[Mm]e llamo|[Mm]i nombre es|[Jj]e m['’]appelle"
_INTRODUCED = rf"(?:(?:{_TITLES})\.?|{_CUES}) "
_PARTICLES = "da|das|de|del|della|den|der|di|do|dos|du|la|las|le|los|ten|ter|van|von|y|zu|zum|zur"
#: Without a final apostrophe, hyphen or genitive.
_NAME = r"\p{Lu}(?:\p{L}|['’](?!s(?!\p{L}))(?=\p{L})|-(?=\p{L})){1,40}"
_WORD_START, _WORD_END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_H = "[0-9A-Fa-f]{1,4}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str


#: Tried in this order at every place.
KINDS = [
    Kind("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"),
    Kind("key", r"(?<![\p{L}\p{N}])(?:AKIA[A-Z0-9]{16,124}|(?:sk|pk|rk|ghp|gho|ghs|ghu|hf|glpat|xox[abprs])[-_][A-Za-z0-9_-]{16,250})(?![\p{L}\p{N}])"),
    Kind("secret", r"(?<![\p{L}\p{N}])(?=[A-Fa-f]{0,127}\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"),
    Kind("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    Kind("ipv6", rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]{{0,40}}\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\p{{L}}\p{{N}}:])"),
    Kind("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    Kind("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.,_+-])[2-9]\d{2}[2-9]\d{6}(?![\p{L}\p{N}_]|[.,-]\d)"),
    Kind("card", r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!-?\d)"),
    Kind("name", rf"{_WORD_START}{_INTRODUCED}(?:(?:{_PARTICLES}) ){{0,3}}{_NAME}(?:(?: (?:{_PARTICLES})){{0,3}} {_NAME}){{0,2}}"),
]
KEY = [_LETTERS, _LETTERS.upper(), DIGITS[0]]
#: A text without any of this has no entity.
_FIRST_LETTERS = "".join(sorted({t[0] for t in _TITLES.split("|")}))
_HINT = rf"[0-9@]|AKIA|(?:sk|pk|rk|gh[opsu]|hf|glpat|xox[abprs])[-_]|(?=[{_FIRST_LETTERS}])(?:{_TITLES})\.? |(?=[MmIiJj])(?:{_CUES}) "


def _text(value: str) -> Column:
    return F.lit(value)


def _split(s: Column) -> Column:
    """The characters of a short string."""
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1))).otherwise(
        F.array().cast("array<string>")
    )


def _shifted(c: Column, by: Column, alphabets: list[str]) -> Column:
    out = c
    for alphabet in alphabets:
        at = F.instr(_text(alphabet), c)
        out = F.when(at > 0, F.substring(_text(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
    return out


def _is_symbol(c: Column, alphabets: list[str]) -> Column:
    return F.instr(_text("".join(alphabets)), c) > 0


def permuted(symbols: Column, label: str, key: str, alphabets: list[str]) -> Column:
    """A keyed permutation of an array of symbols; each stays in its alphabet, and case has no influence."""

    def shift(these: Column, those: Column, number: int) -> Column:
        said = F.concat(_text(f"{key}|{label}|{number}|"), F.size(these).cast("string"), _text("|"), F.lower(F.array_join(those, "")))
        return _let(
            F.sha2(said, 512),
            lambda h: F.transform(
                these,
                lambda c, i: _shifted(
                    c, F.conv(F.substring(h, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), alphabets
                ),
            ),
        )

    half = lambda s: F.ceil(F.size(s) / 2).cast("int")
    pair = _let(
        symbols, lambda s: F.struct(F.slice(s, 1, half(s)).alias("a"), F.slice(s, half(s) + 1, F.size(s)).alias("b"))
    )

    def left(number: int):
        return lambda p: F.struct(shift(p["a"], p["b"], number).alias("a"), p["b"].alias("b"))

    def right(number: int):
        return lambda p: F.struct(p["a"].alias("a"), shift(p["b"], p["a"], number).alias("b"))

    for step in (left(1), right(2), left(3), right(4)):
        pair = _let(pair, step)
    return _let(pair, lambda p: F.concat(p["a"], p["b"]))


def _refilled(s: Column, symbols: Column, alphabets: list[str]) -> Column:
    """s with its symbols replaced in order; all else stays."""
    start = F.struct(_text("").alias("out"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(
        _is_symbol(c, alphabets),
        F.struct(F.concat(a["out"], F.element_at(symbols, a["k"])).alias("out"), (a["k"] + 1).alias("k")),
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
    return F.aggregate(_split(s), start, step, lambda a: a["out"])


def _permuted_string(s: Column, label: str, key: str, alphabets: list[str]) -> Column:
    symbols = F.filter(_split(s), lambda c: _is_symbol(c, alphabets))
    return _let(permuted(symbols, label, key, alphabets), lambda new: _refilled(s, new, alphabets))


def _email(e: Column, key: str) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    reserved = r"(?i)(?:^|\.)example\.(?:com|org|net)$"
    kept = F.when(domain.rlike(reserved), F.substring_index(domain, ".", -2)).otherwise(F.substring_index(domain, ".", -1))
    own = F.substring(domain, F.lit(1), F.length(domain) - F.length(kept))
    return F.concat(_permuted_string(local, "local", key, ANY), _text("@"), _permuted_string(own, "domain", key, ANY), kept)


def _ip(e: Column, key: str) -> Column:
    def half(p: Column, number: int) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(_text(f"{key}|ip|{number}|"), p.cast("string")), 256), 1, 4), 16, 10).cast("int")

    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    pair = _let(octets, lambda o: F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b")))

    def left(number: int):
        return lambda p: F.struct(F.pmod(p["a"] + half(p["b"], number), F.lit(65536)).alias("a"), p["b"].alias("b"))

    def right(number: int):
        return lambda p: F.struct(p["a"].alias("a"), F.pmod(p["b"] + half(p["a"], number), F.lit(65536)).alias("b"))

    for step in (left(1), right(2), left(3), right(4)):
        pair = _let(pair, step)
    whole = lambda x: F.floor(x / 256).cast("int").cast("string")
    rest = lambda x: F.pmod(x, F.lit(256)).cast("string")
    return _let(pair, lambda p: F.concat_ws(".", whole(p["a"]), rest(p["a"]), whole(p["b"]), rest(p["b"])))


def _phone(e: Column, key: str) -> Column:
    country = F.regexp_extract(e, r"^(\+\d{1,3})(?=[ .(-])", 1)
    rest = F.substring(e, F.length(country) + 1, F.length(e))
    return F.concat(country, _permuted_string(rest, "phone", key, DIGITS))


def _luhn(digits: Column) -> Column:
    """The check digit for an array of digits."""
    n = F.size(digits)
    doubled = F.transform(
        digits,
        lambda d, i: F.when(
            F.pmod(n - i, F.lit(2)) == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ).otherwise(d.cast("int")),
    )
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(e: Column, key: str) -> Column:
    digits = F.filter(_split(e), lambda c: _is_symbol(c, DIGITS))

    def replaced(d: Column) -> Column:
        body = F.slice(d, 1, F.size(d) - 1)
        new = F.concat(F.slice(d, 1, 1), permuted(F.slice(d, 2, F.size(d) - 2), "card", key, DIGITS))
        off = F.element_at(d, -1).cast("int") - _luhn(body)
        return _let(new, lambda n: F.concat(n, F.array(F.pmod(_luhn(n) + off, F.lit(10)).cast("string"))))

    return _let(_let(digits, replaced), lambda new: _refilled(e, new, DIGITS))


def _introduction(e: Column) -> Column:
    return F.regexp_extract(e, rf"^({_INTRODUCED})", 1)


def _name(e: Column, key: str) -> Column:
    said = _introduction(e)
    tokens = F.split(F.substring(e, F.length(said) + 1, F.length(e)), " ")

    def token(t: Column) -> Column:
        stem, last = F.substring(t, F.lit(1), F.length(t) - 1), F.substring(t, F.length(t), F.lit(1))
        return F.when(t.rlike(r"^\p{Lu}"), F.concat(_permuted_string(stem, "name", key, NAME), last)).otherwise(t)

    return F.concat(said, F.array_join(F.transform(tokens, token), " "))


def _key(e: Column, key: str) -> Column:
    prefix = F.regexp_extract(e, "^(AKIA|[a-z]{2,5}[-_])", 1)
    return F.concat(prefix, _permuted_string(F.substring(e, F.length(prefix) + 1, F.length(e)), "key", key, KEY))


def _hexadecimal(e: Column, label: str, key: str) -> Column:
    new = _permuted_string(F.lower(e), label, key, HEX)
    return F.when(e.rlike("[A-F]"), F.upper(new)).otherwise(new)


_SURROGATES = {
    "email": _email,
    "key": _key,
    "secret": lambda e, key: _hexadecimal(e, "secret", key),
    "ssn": lambda e, key: _permuted_string(e, "ssn", key, DIGITS),
    "ipv6": lambda e, key: _hexadecimal(e, "ipv6", key),
    "ip": _ip,
    "phone": _phone,
    "card": _card,
    "name": _name,
}


def _kind(e: Column) -> Column:
    out = _text("name")  # a mention, which no pattern describes
    for kind in reversed(KINDS):
        out = F.when(e.rlike(f"^(?:{kind.pattern})$"), F.lit(kind.name)).otherwise(out)
    return out


def _pieces(text: Column) -> Column:
    """A text cut at its entities: ordinary at even, entities at odd places."""
    escaped = F.replace(F.replace(text, _text(ESCAPE), _text(ESCAPE + "b")), _text(MARK), _text(ESCAPE + "a"))
    # A group number in the card pattern counts from the start of the whole pattern.
    every = "|".join(f"(?:{k.pattern})" for k in KINDS)
    marked = F.regexp_replace(escaped, every, f"{MARK}$0{MARK}")
    return F.when(text.rlike(_HINT), F.split(marked, MARK, -1)).otherwise(F.array(escaped))


def _is_entity(i: Column) -> Column:
    return F.pmod(i, F.lit(2)) == 1


def _with_mentions(pieces: Column) -> Column:
    """The pieces cut again where a single name of an entity among them stands as a word of its own."""
    said = F.transform(F.filter(pieces, lambda p, i: _is_entity(i) & p.rlike(f"^{_INTRODUCED}")), lambda e: F.substring(e, F.length(_introduction(e)) + 1, F.length(e)))
    names = F.array_distinct(F.filter(F.flatten(F.transform(said, lambda n: F.split(n, " "))), lambda t: t.rlike(r"^\p{Lu}")))

    def cut(names: Column) -> Column:
        # Names hold letters, apostrophes and hyphens only, so nothing needs quoting.
        mention = F.concat(_text(_WORD_START + r"(?=\p{Lu})(?:"), F.array_join(names, "|"), _text(")" + _WORD_END))
        again = lambda p: F.regexp_replace(p, mention, F.lit(f"{MARK}$0{MARK}"))
        marked = F.transform(pieces, lambda p, i: F.when(_is_entity(i), F.concat(_text(MARK), p, _text(MARK))).otherwise(again(p)))
        return F.when(F.size(names) > 0, F.split(F.array_join(marked, ""), MARK, -1)).otherwise(pieces)

    return _let(names, cut)


def _surrogate(e: Column, key: str) -> Column:
    def of(kind: Column) -> Column:
        out = e
        for name, make in _SURROGATES.items():
            out = F.when(kind == name, make(e, key)).otherwise(out)
        return F.struct(kind.alias("kind"), e.alias("entity"), out.alias("surrogate"))

    return _let(_kind(e), of)


def _unescaped(s: Column) -> Column:
    return F.replace(F.replace(s, _text(ESCAPE + "a"), _text(MARK)), _text(ESCAPE + "b"), _text(ESCAPE))


def _once(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """The frame with a column that is computed once, however often it is used: expressions don't move through a generator."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def _replaced(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, str, str]:
    """All columns and more, two of whose names are given: kind, entity and surrogate of every entity in order, and the new text."""
    first, pieces, found, new_text = (free_name(docs, name) for name in ("_first", "_pieces", "_found", "_new"))
    source = F.col(f"`{text}`")
    with_pieces = _once(_once(docs, _pieces(source), first), _with_mentions(F.col(first)), pieces).drop(first)
    entities = F.filter(pieces, lambda p, i: _is_entity(i))
    with_found = _once(with_pieces, F.transform(entities, lambda e: _surrogate(e, key)), found)
    new = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(_is_entity(i), F.element_at(found, ((i + 1) / 2).cast("int"))["surrogate"]).otherwise(p),
        ),
        "",
    )
    whole = F.when(source.isNull(), F.lit(None)).otherwise(F.when(F.size(pieces) > 1, _unescaped(new)).otherwise(source))
    return with_found.withColumn(new_text, whole), found, new_text


def replace_entities(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in their texts; all other columns stay as they are.

    Defined results: a null text stays null; texts without entities stay as they
    are, byte for byte; repeated rows get the same text. Columns of any name are kept.
    """
    rows, _, new = _replaced(docs, text, key)
    return rows.select(*[F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def surrogates(docs: DataFrame, *, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the new text, n_entities, and entities (kind and surrogate, in order)."""
    rows, found, new = _replaced(docs.select(doc_id, text), text, key)
    return rows.select(
        doc_id,
        F.col(new).alias("text"),
        F.when(F.col(found).isNull(), 0).otherwise(F.size(found)).alias("n_entities"),
        F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), f["surrogate"].alias("surrogate"))).alias("entities"),
    )


def _canonical(kind: Column, e: Column) -> Column:
    """An entity without what is only its form."""
    digits = F.regexp_replace(F.when(kind == "phone", F.regexp_replace(e, r"^\+\d{1,3}(?=[ .(-])", "")).otherwise(e), r"\D", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).otherwise(F.lower(e))


def collisions(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """kind, n_entities, n_surrogates and n_pairs over all documents: equal numbers mean no collision and no split entity."""
    rows, entities, _ = _replaced(docs.select(text), text, key)
    # Written once: the texts would be searched again for each of the three counts.
    found = staged(
        rows.select(F.explode(entities).alias("f"))
        .select(F.col("f.kind").alias("kind"), _canonical(F.col("f.kind"), F.col("f.entity")).alias("e"), _canonical(F.col("f.kind"), F.col("f.surrogate")).alias("s"))
        .distinct(),
        "entities",
    )
    # Three counts of distinct values by two-step aggregates, so a kind isn't gathered in one task.
    by_entity = found.select("kind", "e").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_entities"))
    by_surrogate = found.select("kind", "s").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_surrogates"))
    pairs = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pairs"))
    return by_entity.join(by_surrogate, "kind").join(pairs, "kind")
