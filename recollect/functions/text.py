"""Text functions: lengths, token estimates, topics, privacy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters of the model's word splits: those of ECMAScript's \\s (fixed value).
BLANK = "[\\s\\u00a0\\ufeff\\p{Z}]+"
#: Patterns of secrets (our own table): kind -> pattern and replacement.
SECRETS = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}", "[EMAIL]"),
    "aws_key": ("AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    "api_key": ("sk-[A-Za-z0-9]{16,}", "[API_KEY]"),
    "token": ("gh[pousr]_[A-Za-z0-9]{20,}", "[TOKEN]"),
    "phone": ("\\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}", "[PHONE]"),
}


def text_length(x: Column) -> Column:
    """Length in UTF-16 units; null counts as empty."""
    return F.coalesce((F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long"), F.lit(0).cast("long"))


def tokens_by_length(x: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(text_length(x) / 4)


def tokens_by_words(x: Column) -> Column:
    """1.3 per part between blanks, rounded up; an empty text is one part."""
    return F.ceil(F.size(F.split(F.coalesce(x, F.lit("")), BLANK)) * F.lit(1.3))


def first_words(x: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(x, BLANK), 1, n), " ")


def terms(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


def long_words(x: Column) -> Column:
    """Lower-case words of more than two characters, in order and with repeats."""
    return F.filter(F.split(F.lower(x), BLANK), lambda t: F.length(t) > 2)


def word_set(x: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(long_words(x))


def contains_terms(x: Column, words: list[str], prefixes: tuple[str, ...] = (), any_of: tuple[str, ...] = ()) -> Column:
    """All words occur as terms, some term begins with each prefix, and one of any_of occurs if there are any."""
    found = terms(x)
    begins = lambda p: F.exists(found, lambda t: t.startswith(p))
    tests = [F.array_contains(found, w) for w in words] + [begins(p) for p in prefixes]
    tests += [F.arrays_overlap(found, F.array(*map(F.lit, any_of)))] if any_of else []
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def holds(x: Column, part: str) -> Column:
    """Whether the text contains the part, case aside; % and _ stand for themselves."""
    plain = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return x.ilike(f"%{plain}%")


def tags_text(tags: Column) -> Column:
    """Tags as the JSON array that tags_from_text reads."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def has_private_tags(x: Column) -> Column:
    """Whether a private part is marked; null has none."""
    return F.coalesce(x.rlike("(?is)<(private|secret)>.*?</\\1>"), F.lit(False))


def strip_private_tags(x: Column) -> Column:
    for tag in ("private", "secret"):
        x = F.regexp_replace(x, f"(?is)<{tag}>.*?</{tag}>", f"[{tag.upper()}]")
    return x


def has_secret(x: Column) -> Column:
    """Whether any pattern of a secret occurs; null has none."""
    return F.coalesce(x.rlike("|".join(f"(?:{p})" for p, _ in SECRETS.values())), F.lit(False))


def secret_kinds(x: Column) -> Column:
    """Kinds of secrets found, in the table's order."""
    return F.filter(F.array(*[F.when(x.rlike(p), F.lit(k)) for k, (p, _) in SECRETS.items()]), lambda k: k.isNotNull())


def secret_count(x: Column) -> Column:
    out = F.lit(0)
    for p, _ in SECRETS.values():
        out = out + F.regexp_count(x, F.lit(p))
    return out


def secret_counts(x: Column) -> Column:
    """How often each kind of secret occurs, in the table's order; null has none."""
    return F.array(*[F.coalesce(F.regexp_count(x, F.lit(p)), F.lit(0)) for p, _ in SECRETS.values()])


def counted_kinds(counts: Column) -> Column:
    """Kinds that secret_counts() found."""
    return F.filter(F.array(*[F.when(counts[i] > 0, F.lit(k)) for i, k in enumerate(SECRETS)]), lambda k: k.isNotNull())


def sanitized(x: Column, mode: str = "moderate") -> Column:
    """Private tags replaced, and secrets too unless mode is off."""
    x = strip_private_tags(x)
    if mode != "off":
        for p, new in SECRETS.values():
            x = F.regexp_replace(x, p, F.lit(new))
    return x


def denied(path: Column, patterns: list[str]) -> Column:
    """A path matches a pattern: equal, by suffix (*.ext), below a folder (dir/*), or as a part."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for pattern in patterns:
        q = pattern.lower().replace("\\", "/")
        if q.startswith("*."):
            out = out | p.endswith(q[1:])
        elif q.endswith("/*"):
            out = out | p.startswith(q[:-1]) | p.contains(f"/{q[:-1]}")
        else:
            out = out | p.contains(q)
    return out


def storable(x: Column, path: Column, patterns: list[str], mode: str = "moderate") -> Column:
    """Whether a text may be stored: nothing private, no secret, no denied path; null texts and paths hold nothing that forbids it."""
    if mode == "off":
        return F.lit(True)
    return ~(has_private_tags(x) | has_secret(x) | F.coalesce(denied(path, patterns), F.lit(False)))


def tags_from_text(x: Column) -> Column:
    """JSON array, or else a comma-separated list; trimmed, without empties."""
    parsed = F.coalesce(F.from_json(x, "array<string>", {"mode": "PERMISSIVE"}), F.split(x, ","))
    return F.filter(F.transform(parsed, lambda t: F.trim(t)), lambda t: t != "")


def or_default(x: Column, default: int) -> Column:
    """Null and zero both mean the default."""
    return F.when(x.isNull() | (x == 0), default).otherwise(x)
