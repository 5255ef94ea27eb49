"""Classification by rules, with an optional model in between, and training frames."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Col, as_col, evaluated_once, normalise
from ..params import CASH_WITHDRAWAL, DEFAULTS, UNCATEGORISED, Params

# Cash taken out, matched on the raw text before anything else.
WITHDRAWAL = r"(?iU)\b(atm|cash\s*withdrawal|cash\s*out|cashout|cash\s*back|agent\s*withdrawal)\b"

# Keyword rules on normalised text; the first match wins.
RULES = (
    (r"\b((airtel|mtn|zamtel)\s*money|mobile\s*money|momo\s*transfer)\b", "Transfers"),
    (
        r"\b(shoprite|pick\s*n\s*pay|picknpay|spar|game\s*store|choppies|melissa|food\s*lover|supermarket|grocer|"
        r"butchery|market)\b",
        "Groceries",
    ),
    (
        r"\b(vegetables?|veggies|tomato(es)?|onions?|cabbage|kapenta|mealie\s*meal|bread|milk|eggs|fruits?|bananas?|"
        r"tuntemba)\b",
        "Groceries",
    ),
    (
        r"\b(puma|total|totalenergies|engen|mount\s*meru|petroda|fuel|petrol|diesel|filling\s*station|yango|ulendo|"
        r"taxi|bus\s*fare|intercity|parking|toll|minibus|bus|cab)\b",
        "Transport",
    ),
    (
        r"\b(zesco|prepaid\s*units|lwsc|water\s*bill|nwasco|electricity|utility|garbage|refuse)\b",
        "Utilities",
    ),
    (r"\b(rent|rental|landlord|mortgage|body\s*corporate|service\s*charge)\b", "Housing"),
    (r"\b(pharmacy|chemist|clinic|hospital|medical|dental|dentist|health|laborator)\b", "Healthcare"),
    (
        r"\b(school\s*fees|tuition|unza|cbu|university|college|exam\s*fee|stationery|textbook)\b",
        "Education",
    ),
    (r"\b(airtel|mtn|zamtel|airtime|data\s*bundle|talktime|recharge)\b", "Airtime & Data"),
    (
        r"\b(loan|repayment|instalment|installment|credit\s*card|overdraft|bayport|izwe|microfinance|arrears)\b",
        "Loan & Debt",
    ),
    (
        r"\b(netflix|showmax|spotify|dstv|gotv|multichoice|apple\s*com|google\s*play|youtube\s*premium|microsoft|"
        r"adobe|subscription|amazon\s*prime)\b",
        "Subscriptions",
    ),
    (
        r"\b(kfc|hungry\s*lion|debonairs|steers|pizza|mcdonald|cafe|coffee|restaurant|takeaway|take\s*away|"
        r"chicken\s*inn|grill|lounge)\b",
        "Dining Out",
    ),
    (
        r"\b(cinema|movie|ster\s*kinekor|betting|betway|premierbet|gaming|concert|ticket|lodge|resort|holiday)\b",
        "Entertainment",
    ),
    (
        r"\b(mr\s*price|jet\b|truworths|edgars|pep\b|woolworths|clothing|boutique|electronics|hardware|furniture|"
        r"jumia|shopping)\b",
        "Shopping",
    ),
    (r"\b(salon|barber|spa\b|cosmetic|beauty|gym|fitness)\b", "Personal Care"),
    (r"\b(transfer|sent\s*to|mobile\s*money|momo|zoona|western\s*union)\b", "Transfers"),
)


def _spellings(pattern: str) -> set[str]:
    """The texts a rule's pattern stands for, with a blank where its words may come apart."""

    def alternatives(i: int) -> tuple[set[str], int]:
        found, here = set(), {""}
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                found, here, i = found | here, {""}, i + 1
                continue
            if pattern.startswith(r"\b", i):
                i += 2
                continue
            if pattern.startswith(r"\s*", i):
                piece, i = {" "}, i + 3
            elif pattern[i] == "(":
                piece, i = alternatives(i + 1)
                i += 1
            elif pattern[i].isalnum():
                piece, i = {pattern[i]}, i + 1
            else:
                raise ValueError(f"not a keyword pattern: {pattern}")
            if pattern[i : i + 1] == "?":
                piece, i = piece | {""}, i + 1
            here = {x + y for x in here for y in piece}
        return found | here, i

    return alternatives(0)[0]


def _trie(words: set[str]) -> str:
    """A pattern of a set of words that tries a common beginning once."""
    heads: dict[str, set[str]] = {}
    for word in words - {""}:
        heads.setdefault(word[0], set()).add(word[1:])
    branches = [letter + _trie(rest) for letter, rest in sorted(heads.items())]
    body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")" if branches else ""
    return f"(?:{body})?" if body and "" in words else body


def _rule_words() -> set[str]:
    """Every word that can be part of a rule's match: words of a phrase may be written together."""
    phrases = [s.split(" ") for pattern, _ in RULES for s in _spellings(pattern)]
    return {"".join(p[i:j]) for p in phrases for i in range(len(p)) for j in range(i + 1, len(p) + 1)}


#: A word of a normalised text that no rule's match can hold, with the blank behind it.
_OTHER_WORD = rf"\b(?!{_trie(_rule_words())}\b)[a-z0-9]++ ?+"


def rule_words(text: Col) -> Column:
    """A normalised text with dots for its words that are part of no rule: the rules match it as they match the text."""
    return F.regexp_replace(F.regexp_replace(as_col(text), _OTHER_WORD, "."), r"\.{2,}", ".")


def is_withdrawal(c: Col) -> Column:
    """Whether a text speaks of cash taken out. The pattern, case-blind in all scripts, is slow: most texts lack its first words."""
    raw = F.coalesce(as_col(c), F.lit(""))
    low = F.lower(raw)
    first = low.contains("atm") | low.contains("agent") | F.replace(low, F.lit("ſ"), F.lit("s")).contains("cash")
    return first & raw.rlike(WITHDRAWAL)


def rule_category(c: Col, text: Col | None = None, words: Col | None = None) -> Column:
    """Category by keyword, or NULL. ``text`` is the normalised form, ``words`` its ``rule_words``, when at hand.

    What isn't at hand is bound as a one-element array, so it is worked out once and not once a rule;
    ``with_rule_category`` does the same with generated code.
    """
    if text is None:
        return F.element_at(F.transform(F.array(normalise(c)), lambda clean: rule_category(c, clean)), 1)
    if words is None:
        return F.element_at(F.transform(F.array(rule_words(text)), lambda known: rule_category(c, text, known)), 1)
    known, none = as_col(words), F.lit(None).cast("string")
    out = F.when(as_col(text) == "", none).when(is_withdrawal(c), CASH_WITHDRAWAL).when(known.isin("", "."), none)
    for pattern, name in RULES:
        out = out.when(known.rlike(pattern), name)
    return out


def with_rule_category(df: DataFrame, name: str = "category_name", raw: str = "description", text: str | None = None) -> DataFrame:
    """Adds the category by keyword of the column ``raw``; ``text`` names the column with its normalised form, if there is one."""
    clean = df.withColumn("_clean", normalise(raw) if text is None else F.col(text)).withColumn("_words", rule_words("_clean"))
    return evaluated_once(clean, df.columns, F.struct(rule_category(raw, "_clean", "_words").alias(name)))


def classify(df: DataFrame, model=None, params: Params = DEFAULTS) -> DataFrame:
    """Sets category_name, category_confidence and category_source.

    A withdrawal is decided by rule. Otherwise the model's answer stands when it
    is confident enough, else the rules', else the row stays uncategorised.
    ``model`` has ``predict(df)``, which adds predicted_category and
    predicted_probability from the ``text`` column.
    """
    result = ["category_name", "category_confidence", "category_source"]
    rows = df.drop(*result).withColumn("text", normalise("description"))
    if model is not None:
        rows = model.predict(rows)
        confident = (F.col("predicted_probability") >= params.confidence_floor) & (F.col("text") != "")
        guess, sure = F.when(confident, F.col("predicted_category")), F.col("predicted_probability")
    else:
        guess, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = rows.withColumns({"withdrawal": is_withdrawal("description"), "guess": guess, "_words": rule_words("text")}).withColumn(
        "ruled", rule_category("description", "text", "_words")
    )

    def answer(name: Column, confidence: Column | float, source: str) -> Column:
        if not isinstance(confidence, Column):
            confidence = F.lit(confidence)
        return F.struct(
            name.alias("category_name"),
            confidence.cast("double").alias("category_confidence"),
            F.lit(source).alias("category_source"),
        )

    verdict = (
        F.when(F.col("withdrawal"), answer(F.lit(CASH_WITHDRAWAL), 1.0, "rule"))
        .when(F.col("guess").isNotNull(), answer(F.col("guess"), sure, "model"))
        .when(F.col("ruled").isNotNull(), answer(F.col("ruled"), 1.0, "rule"))
        .otherwise(answer(F.lit(UNCATEGORISED), 0.0, "default"))
    )
    return evaluated_once(rows, [c for c in df.columns if c not in result], verdict)


def features(df: DataFrame) -> DataFrame:
    """text, amount, day_of_week (Monday 0) and day_of_month, neutral when missing."""
    return df.withColumns(
        {
            "text": normalise("description"),
            "amount": F.coalesce(F.col("amount").cast("double"), F.lit(0.0)),
            "day_of_week": F.coalesce(F.weekday("txn_date"), F.lit(0)),
            "day_of_month": F.coalesce(F.dayofmonth("txn_date"), F.lit(1)),
        }
    )


#: Copies of the seed that thin accounts are spread over.
SEED_COPIES = 64

FRAME = ["text", "amount", "day_of_week", "day_of_month", "category_name", "category_source"]


def training_frame(ledger: DataFrame, category: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labelled debits as features; ``weight`` counts a user's correction three times."""
    labelled = ledger.filter(
        (F.col("txn_type") == "DEBIT") & (F.col("category_name") != UNCATEGORISED)
    ).join(category.select("category_name"), "category_name", "left_semi")
    return (
        features(labelled)
        .filter(F.col("text") != "")
        .withColumn("weight", F.when(F.col("category_source") == "user", DEFAULTS.correction_weight).otherwise(1))
        .select(*FRAME, "weight", *keep)
    )


def repeated(frame: DataFrame) -> DataFrame:
    """The frame with every row as often as its weight, for learners without weights."""
    return frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("copy")


def with_bootstrap(frame: DataFrame, seed: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds the seed rows to accounts whose own rows are too few or of one class.

    frame has user_id; every account of it is judged on its own.
    """
    thin = (
        frame.groupBy("user_id")
        .agg(F.sum("weight").alias("n"), F.min("category_name").alias("a"), F.max("category_name").alias("z"))
        .filter((F.col("n") < params.min_training_rows) | (F.col("a") == F.col("z")))
        .select("user_id")
    )
    rows = seed.select(*FRAME, F.lit(1).alias("weight"))
    # Every thin account gets every seed row; parts of the accounts meet copies of the seed.
    part = F.pmod(F.xxhash64("user_id"), F.lit(SEED_COPIES)).alias("part")
    copies = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEED_COPIES - 1).cast("long"))))
    extra = thin.select("user_id", part).join(copies, "part")
    return frame.select("user_id", *rows.columns).unionByName(extra.select("user_id", *rows.columns))


def relabel(ledger: DataFrame, model=None) -> DataFrame:
    """Classify again what is still uncategorised and not set by the user."""
    open_rows = (
        (F.col("txn_type") == "DEBIT")
        & (F.col("category_name") == UNCATEGORISED)
        & (F.coalesce("category_source", F.lit("")) != "user")
    )
    stays = ~F.coalesce(open_rows, F.lit(False))
    fresh = classify(ledger.filter(~stays), model)
    return ledger.filter(stays).unionByName(fresh.select(*ledger.columns))


def apply_corrections(ledger: DataFrame, corrections: DataFrame, category: DataFrame) -> DataFrame:
    """User labels override: corrections are (txn_key, category_name, corrected_at).

    The latest correction of a row counts; unknown categories are ignored.
    """
    latest = (
        corrections.join(category.select("category_name"), "category_name", "left_semi")
        .groupBy("txn_key")
        .agg(F.max_by("category_name", F.struct("corrected_at", "category_name")).alias("corrected"))
    )
    fixed = F.col("corrected").isNotNull()
    return (
        ledger.join(latest, "txn_key", "left")
        .withColumns(
            {
                "category_name": F.coalesce("corrected", "category_name"),
                "category_source": F.when(fixed, "user").otherwise(F.col("category_source")),
                "category_confidence": F.when(fixed, 1.0).otherwise(F.col("category_confidence")),
            }
        )
        .drop("corrected")
        .select(*ledger.columns)
    )
