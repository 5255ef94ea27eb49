"""Text expressions. All are built-in column expressions, so they stay in codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..schema import rnd

Col = Column | str


def as_col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(c: Col) -> Column:
    """Lower case, punctuation to spaces, whitespace collapsed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def merchant_key(c: Col, words: int = 3) -> Column:
    """The first words of the normalised text that are not plain numbers."""
    tokens = F.filter(F.split(normalise(c), " "), lambda t: t.rlike("[a-z]"))
    return F.array_join(F.slice(tokens, 1, words), " ")


WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u202f\u3000"


def strip(c: Col) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def _needles(parsed) -> set[str] | None:
    """Texts of which every match of a parsed pattern holds one; None where it has none for certain."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found, run = [*found, {run}], ""
        inner = None
        if op is _constants.SUBPATTERN and not value[1]:
            inner = _needles(value[3])
        elif op is _constants.BRANCH:
            parts = [_needles(x) for x in value[1]]
            inner = None if None in parts else set().union(*parts)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] >= 1:
            inner = _needles(value[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def holds(c: Col, pattern: str) -> Column:
    """Whether a text has a match of a case-sensitive pattern.

    Plain words of which a match holds one are looked for first: most texts have none of them, and
    that takes a small part of a pattern's time.
    """
    parsed, text = _parser.parse(pattern), as_col(c)
    words = None if parsed.state.flags & re.IGNORECASE else _needles(parsed)
    if not words:
        return text.rlike(pattern)
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in sorted(words)]) & text.rlike(pattern)


def evaluated_once(df: DataFrame, keep: Sequence[str], answer: Column) -> DataFrame:
    """The kept columns and the fields of a struct, generated once per row.

    A later filter on a generated column is not pushed below the generator, so a
    long expression is never copied into the filter and evaluated again.
    """
    return df.select(*keep, F.inline(F.array(answer)))


def collapse(c: Col) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"(?U)\s+", " "))


def search(text: Col, needle: Col) -> Column:
    """Case-insensitive substring; % and _ have no special meaning."""
    return F.contains(F.lower(as_col(text)), F.lower(as_col(needle)))


def has_words(normalised: Col, phrase: Col) -> Column:
    """Whole-word containment of a phrase in already normalised text."""
    blank = F.lit(" ")
    return F.contains(
        F.concat(blank, as_col(normalised), blank), F.concat(blank, as_col(phrase), blank)
    )


def any_word(words: Sequence[str]) -> str:
    return r"\b(" + "|".join(re.escape(w) for w in words) + r")\b"


# --- Channels ---------------------------------------------------------------

def channel(import_hash: Col, description: Col) -> Column:
    """Wallet, bank or cash, from where the row came from and its wording."""
    origin = F.lower(F.coalesce(as_col(import_hash), F.lit("")))
    text = F.lower(F.coalesce(as_col(description), F.lit("")))
    return (
        F.when(origin.startswith("sync-momo-mtn-") | text.contains("mtn momo") | text.contains("momo pay"), "mtn")
        .when(origin.startswith("sync-momo-airtel-") | text.contains("airtel money"), "airtel")
        .when(origin.startswith("manual-"), "cash")
        .otherwise("bank")
    )


# --- Currency ---------------------------------------------------------------

# Local-currency marks, then foreign marks in order of preference.
LOCAL_MARK = r"(?U)(\bZMW\b|\bZK\b|\bK\s?\d)"
FOREIGN_MARKS = (
    ("USD", r"(?U)(US\$|\bUSD\b|\$)"),
    ("EUR", r"(?U)(€|\bEUR\b)"),
    ("GBP", r"(?U)(£|\bGBP\b)"),
    ("ZAR", r"(?U)(\bZAR\b|\bR\s?\d)"),
)


def currency(c: Col) -> Column:
    """Foreign currency code named by a text; NULL when local or unmarked."""
    text = as_col(c)
    out = F.when(text.rlike(LOCAL_MARK), F.lit(None).cast("string"))
    for code, pattern in FOREIGN_MARKS:
        out = out.when(text.rlike(pattern), F.lit(code))
    return out


def fx_tolerance(amount: Col, converted: Col) -> Column:
    share = F.abs(as_col(amount).cast("double")) * DEFAULTS.fx_tolerance
    return F.when(as_col(converted), rnd(share)).otherwise(F.lit(DEFAULTS.exact_tolerance))


# --- Messages ---------------------------------------------------------------

# Fixed value: wording of a trial announcement.
TRIAL = r"(?iU)\b(free\s+trial|trial)\b"

# Subject fragments of receipt-like messages.
RECEIPT_SUBJECT_WORDS = (
    "receipt", "order", "trip", "invoice", "payment", "purchase", "billing", "subscription", "trial",
)

# Merchants known to send digital receipts.
RECEIPT_MERCHANTS = (
    "uber", "bolt", "lyft", "yango", "indrive", "ubuntu cab", "little cab", "careem", "didi",
    "uber eats", "glovo", "jumia food", "mr d", "deliveroo", "doordash", "grubhub", "kfc",
    "hungry lion", "debonairs", "steers", "nandos", "pizza hut", "dominos", "mcdonald",
    "chicken inn", "subway", "galitos",
    "amazon", "takealot", "jumia", "aliexpress", "alibaba", "shein", "temu", "ebay", "etsy",
    "kilimall", "konga", "zando", "superbalist",
    "shoprite", "pick n pay", "picknpay", "spar", "checkers", "woolworths", "game store",
    "game stores", "mr price", "edgars", "builders", "cash crusaders",
    "netflix", "spotify", "showmax", "dstv", "gotv", "multichoice", "youtube", "apple", "itunes",
    "app store", "google", "play store", "microsoft", "xbox", "playstation", "steam", "canva",
    "adobe", "prime video", "amazon prime",
    "airtel", "mtn", "zamtel", "vodacom", "safaricom",
    "airbnb", "booking", "expedia", "emirates", "kenya airways", "ethiopian", "proflight",
    "airlink", "fastjet", "mahogany air", "qatar airways", "turkish airlines",
    "betway", "gal sport", "premierbet", "betpawa",
    "paypal", "flutterwave", "payfast", "stripe",
    "link pharmacy", "clicks", "dischem", "pharmacy",
)


def _longest_first(words: Sequence[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


def receipt_keywords(c: Col) -> Column:
    """Every receipt merchant named in the text, longest keyword first."""
    words = ", ".join(f"'{w}'" for w in _longest_first(RECEIPT_MERCHANTS))
    known = F.expr(f"array({words})")
    # The text is bound as a one-element array, so it is normalised once per row.
    found = F.transform(F.array(normalise(c)), lambda text: F.filter(known, lambda w: F.contains(text, w)))
    return F.element_at(found, 1)


def receipt_keyword(c: Col) -> Column:
    """The longest receipt merchant named in the text, or NULL."""
    return F.try_element_at(receipt_keywords(c), F.lit(1))


def emails_receipt(c: Col) -> Column:
    pattern = "|".join(re.escape(w) for w in RECEIPT_MERCHANTS)
    return normalise(c).rlike(pattern)


def message_merchant(name: Col, address: Col, subject: Col) -> Column:
    """struct<keyword, merchant> of a message, fields NULL when no merchant is known."""
    keyword = receipt_keyword(F.concat_ws(" ", as_col(name), as_col(address), as_col(subject)))
    display = F.when(F.contains(normalise(name), keyword), as_col(name)).otherwise(F.initcap(keyword))
    return F.struct(
        keyword.alias("keyword"),
        F.when(keyword.isNotNull(), F.left(display, F.lit(60))).alias("merchant"),
    )


def free_trial(subject: Col, text: Col, amount: Col) -> Column:
    words = F.concat_ws("\n", as_col(subject), as_col(text))
    return words.rlike(TRIAL) & ~F.coalesce(as_col(amount) > 0, F.lit(False))


def receipt_subject(c: Col) -> Column:
    return F.lower(as_col(c)).rlike("|".join(RECEIPT_SUBJECT_WORDS))


def sender(c: Col) -> Column:
    """struct<name, address> of a From header."""
    head = as_col(c)
    bracketed = head.rlike("<[^>]*>")
    name = F.regexp_extract(head, r'^\s*"?([^"<]*?)"?\s*<', 1)
    address = F.when(bracketed, F.regexp_extract(head, "<([^>]*)>", 1)).otherwise(head)
    return F.struct(
        F.when(bracketed, F.trim(name)).otherwise("").alias("name"),
        F.lower(F.trim(address)).alias("address"),
    )


def sent_date(c: Col) -> Column:
    """Local date of a mail Date header, in the session time zone."""
    head = F.regexp_replace(F.trim(as_col(c)), r"^[A-Za-z]{3},\s*", "")
    return F.to_date(F.try_to_timestamp(head, F.lit("d MMM yyyy HH:mm:ss Z")))


def message_key(message_id: Col, date: Col, sender_text: Col, subject: Col) -> Column:
    own = F.trim(F.coalesce(as_col(message_id), F.lit("")))
    fallback = F.concat_ws("|", *[F.coalesce(as_col(c), F.lit("")) for c in (date, sender_text, subject)])
    return F.when(own != "", own).otherwise(fallback)


# --- Phone numbers ----------------------------------------------------------

# Number prefixes of the mobile networks.
WALLET_PREFIXES = {"mtn": ("096", "076"), "airtel": ("097", "077")}


def phone_number(c: Col) -> Column:
    digits = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\D", "")
    national = F.when(
        digits.startswith("260") & (F.length(digits) == 12), F.concat(F.lit("0"), F.substring(digits, 4, 9))
    ).otherwise(digits)
    return F.when(national.rlike(r"^0[79]\d{8}$"), national)


def phone_mask(c: Col, wallet: Col) -> Column:
    """'NNN ••• NNNN' when the number belongs to the wallet's network, else NULL."""
    number = phone_number(c)
    valid = F.lit(False)
    for name, prefixes in WALLET_PREFIXES.items():
        valid = valid | ((as_col(wallet) == name) & F.left(number, F.lit(3)).isin(*prefixes))
    return F.when(valid, F.concat(F.left(number, F.lit(3)), F.lit(" ••• "), F.right(number, F.lit(4))))
