"""Column functions of the record model: cleaning, identifiers, names, times and access levels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply prefixes, entity types, roles and the levels they may see.
REPLY_PREFIXES = ["re", "fwd", "fw", "aw", "sv", "antw"]
ROLE_LEVELS = {"guest": ["public"], "member": ["public", "internal"], "admin": ["public", "internal", "restricted"]}
OPEN_END = 9_999_999_999
#: Names of entity types by what extractors call them.
ENTITY_TYPES = {
    "PERSON": "Person", "PEOPLE": "Person", "ORG": "Organization", "ORGANIZATION": "Organization", "ACCOUNT": "Account",
    "PROJECT": "Project", "DOCUMENT": "Document", "DOC": "Document", "ISSUE": "Issue", "TICKET": "Issue",
    "REPOSITORY": "Repository", "REPO": "Repository", "FEATURE": "Feature", "SYSTEM": "System", "FACT_STATE": "FactState",
}


def entity_type(value: Column) -> Column:
    """The name of an entity type; others have each run of letters capitalised, a missing one is Entity."""
    known = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.when(F.coalesce(value, F.lit("")) == "", "Entity").otherwise(F.coalesce(F.try_element_at(known, F.upper(value)), title_case(value)))


def title_case(value: Column) -> Column:
    """Each run of letters with a capital first letter, all others small."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def first_non_empty(*columns: Column | str, default: str = "") -> Column:
    cols = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return F.coalesce(*cols, F.lit(default))


def stable_id(*parts: Column | str, skip_empty: bool = True) -> Column:
    """24 hex digits of the SHA-1 of the parts joined by `|`; empty parts dropped or kept."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    cols = [F.nullif(c, F.lit("")) if skip_empty else F.coalesce(c, F.lit("")) for c in cols]
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, 24)


def normalize_value(value: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(F.lower(value)), r"\s+", " ")
    return F.regexp_replace(squeezed, r"[^a-z0-9 ._:/-]", "")


def slug(text: Column, separator: str = "_", size: int = 80) -> Column:
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", separator)
    return F.substring(F.btrim(words, F.lit(separator)), 1, size)


def subject_key(subject: Column) -> Column:
    """One reply prefix off, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), rf"(?i)^\s*({'|'.join(REPLY_PREFIXES)})\s*[:-]\s*", "")))


def confidence(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.5))


def epoch_seconds(value: Column, default: int | None = None) -> Column:
    """Seconds of a number, numeric text, ISO time or a date anywhere in the text; UTC."""
    text = F.trim(value.cast("string"))
    day = F.regexp_replace(F.regexp_extract(text, r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1), "/", "-")
    return F.coalesce(
        text.try_cast("double").cast("long"), F.unix_timestamp(F.try_to_timestamp(text)), F.unix_timestamp(F.try_to_timestamp(day, F.lit("y-M-d"))),
        F.lit(default).cast("long"),
    )


#: What counts as a token in retrieval and in deduplication.
RETRIEVAL_TOKEN, DEDUP_TOKEN = r"[a-z0-9][a-z0-9_./:-]*", "[a-z0-9]+"


def retrieval_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RETRIEVAL_TOKEN), F.lit(0))


def dedup_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(DEDUP_TOKEN), F.lit(0))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of `size` tokens; a shorter text is one shingle, an empty one none."""

    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, size), " "))
        short = F.array(F.array_join(t, " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) <= size, short).otherwise(F.array_distinct(runs))

    return bound(tokens, cut)


def first_token(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(name), r"^(\S*)", 1))


def identifiers(texts: Column) -> Column:
    """E-mail addresses and @handles in an array of strings, lower case, sorted."""
    found = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\w.+-]+@[\w-]+\.[\w.-]+|(?<![\w.])@[\w.-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, found))))


def email_domains(texts: Column) -> Column:
    found = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\w.+-]+@([\w-]+\.[\w.-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, found))))


#: Entities that are unescaped.
HTML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """Tags to a space, common entities unescaped, white space squeezed and trimmed."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for name, character in HTML_ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def ascii_slug(text: Column, size: int = 80, default: str = "brain") -> Column:
    """Lower-case ASCII words joined by `-`, letters without their accents; default where nothing is left."""
    plain = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.rtrim(slug(plain, "-", size), F.lit("-")), F.lit("")), F.lit(default))


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c) == chr(c).lower()]
    pairs = [(c, x) for c, x in pairs if x.isascii()]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


_ACCENTED, _PLAIN = _accents()


def clean_repo(value: Column) -> Column:
    """owner/name of a repository in any of its forms: bare, link, https, ssh, with .git, query or fragment."""
    text = F.trim(value)
    text = F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"^\[[^\]]*\]\(([^)]+)\)", 1)), F.lit("")), text)
    ssh = F.nullif(F.trim(F.regexp_extract(text, r"^git@github\.com[:/](.+)", 1)), F.lit(""))
    url = F.nullif(F.trim(F.regexp_extract(text, r"^https?://(?:www\.)?github\.com/([^/]+/[^/]+)", 1)), F.lit(""))
    text = F.rtrim(F.regexp_extract(F.coalesce(ssh, url, text), r"^[^?#]*", 0), F.lit("/"))
    return F.regexp_replace(text, r"\.git$", "")


def lenient_int(value: Column, default: int = 0) -> Column:
    """A number or numeric text towards zero; default for null, empty and other text."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")).try_cast("double").cast("long"), F.lit(default).cast("long"))


def valid_from(value: Column, timestamp: Column) -> Column:
    """value as lenient_int, or where it is missing the seconds of an ISO time; 0 on failure."""
    missing = F.coalesce(value.cast("string"), F.lit("")) == ""
    return F.when(~missing, lenient_int(value)).otherwise(F.coalesce(F.unix_timestamp(F.try_to_timestamp(timestamp)), F.lit(0).cast("long")))


def without_mention(text: Column, bot: str) -> Column:
    """A message without the bot's @-mention and what blanks stand around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)@\s*{re.escape(bot)}\b[ !:,]*", " "), r"[ \t]+", " "))


def comparable_time(value: Column) -> Column:
    """(rank, number, text) that orders times: missing ones first, then other text, then numbers and ISO times."""
    text = F.trim(value.cast("string"))
    number = F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1_000_000)
    rank = F.when(F.coalesce(text, F.lit("")) == "", -1).when(number.isNull(), 0).otherwise(1)
    return F.struct(rank.alias("rank"), F.coalesce(number, F.lit(0.0)).alias("number"), F.when(rank == 0, text).otherwise("").alias("text"))


def display_title(*columns: Column | str, size: int = 180) -> Column:
    """The first column that is not blank, on one line, cut to size."""
    tidy = [F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns]
    return F.substring(F.replace(F.coalesce(*tidy, F.lit("")), F.lit("\n"), F.lit(" ")), 1, size)


def score_word(value: Column) -> Column:
    """A judge's score: yes, partial or no; anything else is no."""
    tidy = F.lower(F.trim(F.coalesce(value, F.lit("no"))))
    return F.when(tidy.isin("yes", "partial", "no"), tidy).otherwise("no")


def score_value(word: Column) -> Column:
    return F.when(word == "yes", 1.0).when(word == "partial", 0.5).otherwise(0.0)


def completeness(*columns: Column | str) -> Column:
    """How many of the columns are neither null nor empty text."""
    filled = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) != "" for c in columns]
    return sum((x.cast("int") for x in filled), F.lit(0))


def access_level(role: Column, override: Column | None = None) -> Column:
    """What a role's uploads are by default (admin and member internal, guest public), or a valid override; else an error."""
    given = F.lower(F.trim(override)) if override is not None else F.lit(None).cast("string")
    kind = F.lower(F.trim(role))
    default = F.when(kind.isin("admin", "member"), "internal").when(kind == "guest", "public")
    bad = F.raise_error(F.concat(F.lit("unknown level or role: "), F.coalesce(given, kind, F.lit("null")))).cast("string")
    return F.when(given.isNotNull(), F.when(given.isin("public", "internal", "restricted"), given).otherwise(bad)).otherwise(F.coalesce(default, bad))


def timestamp_sort_value(text: Column) -> Column:
    """The first six digit groups as one number; null without digits."""
    groups = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    return F.array_join(F.slice(groups, 1, 6), "").try_cast("decimal(38,0)")


def visible_to(level: Column, role: Column) -> Column:
    """Whether a role may see a level; a missing level is public, an unknown role an error."""
    out = F.lit(None).cast("boolean")
    for name, levels in ROLE_LEVELS.items():
        out = F.when(role == name, F.coalesce(level, F.lit("public")).isin(levels)).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("boolean"))
