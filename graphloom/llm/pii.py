"""Personal data: expressions propose spans, checksums confirm them, context words score them.

Everything is a projection of built-in functions: no shuffle, no Python. A
pattern's matches come from ``regexp_extract_all`` and their places from the
lengths of the pieces that ``split`` leaves between them, so positions are code
points. Patterns are written without backtracking (possessive repeats, anchored
starts), which keeps them linear in very long texts.

Kinds: ``email ip card phone`` are the base kinds and always stay when their
check holds. ``iban`` (mod-97), ``local_phone`` (no checksum) and ``secret`` (letters
and digits of many kinds) are added where the score reaches ``threshold`` and they
touch no base span. Whole words within REACH characters to both sides raise the
score (``tel``, ``token``) or lower it (``isbn``, ``order``).

Defined results for odd rows: a null text counts as empty and has no spans; a
null id stays null; repeated rows each get their own row; other columns are
neither read nor returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn's sum over the digits ``d``, from the right, is a multiple of ten.
LUHN = let(
    f"reverse({DIGITS})",
    "d",
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + let_digit) % 10 = 0".replace(
        "let_digit",
        "IF(i % 2 = 1, int(substr(d, i, 1)), 2 * int(substr(d, i, 1)) - IF(int(substr(d, i, 1)) > 4, 9, 0))",
    ),
)
#: The account number moved behind its first four characters, letters as 10 to 35, leaves 1 modulo 97.
MOD97 = let(
    "replace(m, ' ', '')",
    "s",
    "aggregate(split(concat(substr(s, 5), substr(s, 1, 4)), '(?<=.)(?=.)'), 0, (a, c) -> "
    "IF(c <= '9', a * 10 + ascii(c) - 48, a * 100 + ascii(c) - 55) % 97) = 1",
)
OCTETS = "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)"


#: Letters and digits, ten characters of different kinds at least: chance strings, not words.
MIXED = "m rlike '[0-9]' AND m rlike '[A-Za-z]' AND size(array_distinct(split(m, '(?<=.)(?=.)'))) >= 10"


@dataclass(frozen=True)
class Kind:
    """A pattern (Java syntax), a quick test of the text, a check of the match ``m``, and words that speak for it or against."""

    name: str
    pattern: str
    hint: str
    check: str
    base: float
    words: str
    against: str = ""
    base_kind: bool = True


LOCAL = "[A-Za-z0-9._%+-]"
PHONE = "tel|telephone|téléphone|telefon|teléfono|phone|call|fax|mobile|mobil|móvil|handy"
NUMBERS = "isbn|issn|ean|order|invoice|serial|version|sku"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0", "true", 0.9, "mail|email|e-mail|contact|write|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "instr(t, '.') > 0", OCTETS, 0.6, "ip|ips|host|server|address|adresse", "version|release"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", "true", LUHN, 0.6, "card|cards|visa|credit|carte|karte|tarjeta", NUMBERS),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "instr(t, '+') > 0", f"length({DIGITS}) BETWEEN 9 AND 15", 0.7, PHONE, NUMBERS),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "true", MOD97, 0.6, "iban|account|bank|konto|compte|cuenta", NUMBERS, False),
    Kind("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", "true", "true", 0.3, PHONE, NUMBERS, False),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", "true", MIXED, 0.3, "token|tokens|secret|secrets|password|passwd|pwd|key|apikey|api_key|api-key|access_key|credential|credentials|bearer|auth", "sha|sha1|sha256|md5|checksum|commit", False),
)
#: What a word near a span adds or takes, how near it is, and the score that added kinds need.
CONTEXT_GAIN, CONTEXT_LOSS, REACH, THRESHOLD = 0.3, 0.3, 40, 0.5


def whole(words: str) -> str:
    """A pattern of any of the words, alone among other characters."""
    return rf"[^\p{{L}}\p{{N}}_](?:{words})[^\p{{L}}\p{{N}}_]"


def _found(kind: Kind, rank: int) -> str:
    """SQL: the kind's confirmed matches in ``t`` as structs (start, rank, kind, end, text, score)."""
    p = kind.pattern.replace("\\", "\\\\")
    places = (
        "aggregate(sequence(1, size(ms)), struct(0 AS at, cast(array() AS array<int>) AS starts), (a, i) -> struct("
        "a.at + length(gaps[i - 1]) + length(ms[i - 1]) AS at, array_append(a.starts, a.at + length(gaps[i - 1])) AS starts), a -> a.starts)"
    )
    # one character more on each side tells whether a word is whole there
    near = (
        f"lower(concat(IF(x.s <= {REACH}, ' ', ''), substr(t, greatest(x.s - {REACH + 1}, 0) + 1, least({REACH + 1}, x.s)), '  ', "
        f"substr(t, x.s + length(x.m) + 1, {REACH + 1}), IF(x.s + length(x.m) + {REACH} >= length(t), ' ', '')))"
    )
    words = [(w, g) for w, g in ((kind.words, CONTEXT_GAIN), (kind.against, -CONTEXT_LOSS)) if w]
    score = f"{kind.base}D + " + let(near, "c", " + ".join("IF(c rlike '{}', {}D, 0D)".format(whole(w).replace("\\", "\\\\"), g) for w, g in words))
    spans = let(
        f"split(t, '{p}')",
        "gaps",
        let(
            places,
            "starts",
            "transform(filter(zip_with(ms, starts, (m, s) -> struct(m, s, "
            f"{kind.check} AS ok)), x -> x.ok), x -> struct(x.s AS start, {rank} AS rank, '{kind.name}' AS kind, "
            f"x.s + length(x.m) AS end, x.m AS text, {score} AS score))",
        ),
    )
    none = "cast(array() AS array<struct<start: int, rank: int, kind: string, end: int, text: string, score: double>>)"
    matches = let(f"regexp_extract_all(t, '{p}', 0)", "ms", f"IF(size(ms) = 0, {none}, {spans})")
    return f"IF({kind.hint}, {matches}, {none})"


def pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row the confirmed spans: ``spans array<struct<start, rank, kind, end, text, score>>``,
    by start and then kind, and ``base_spans`` with the base kinds alone."""
    texts = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    base = [(r, k) for r, k in enumerate(KINDS) if k.base_kind]
    more = [(r, k) for r, k in enumerate(KINDS) if not k.base_kind]
    found = texts.select(
        "doc_id",
        F.expr("sort_array(concat(" + ", ".join(_found(k, r) for r, k in base) + "))").alias("base_spans"),
        F.expr("concat(" + ", ".join(_found(k, r) for r, k in more) + ")").alias("more"),
    )
    clear = f"filter(more, x -> x.score >= {threshold}D AND NOT exists(base_spans, b -> b.start < x.end AND x.start < b.end))"
    return found.select("doc_id", "base_spans", F.expr(f"IF(size(more) = 0, base_spans, sort_array(concat(base_spans, {clear})))").alias("spans"))


def joined(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
