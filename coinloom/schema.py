"""Tables, enumerations and the named predicates that all operators share.

Money is exact decimal; a direction, never a sign, says which way it went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"
DEBIT, CREDIT = "Debit", "Credit"
PERSON, PERSON_MEMORY, TRANSFER_DETECTOR = "PERSON", "PERSON_MEMORY", "TRANSFER_DETECTOR"
BILL_PAYMENT, SELF_TRANSFER = "CREDIT_CARD_BILL_PAYMENT", "SELF_TRANSFER"
STAGES = ("CC_RULE", "T1_SOURCE_CATEGORY", "T2_MERCHANT_MAP", "T3_RULE")
CANONICAL, FUZZY = "CANONICAL", "FUZZY"
GAP, PARTIAL, COVERED = "GAP", "PARTIAL", "COVERED"
STATEMENT, ALERT = "Statement", "Alert"
RECONCILED, NEEDS_REVIEW = "RECONCILED", "NEEDS_REVIEW"

TABLES = {
    "accounts": "id string, account_seq long, name string, bank_code string, is_credit_card boolean, currency string, created_at string, updated_at string, last4 string, owner string",
    "categories": "id string, name string, classification string, is_builtin boolean",
    "transactions": (
        f"id string, txn_seq long, account_id string, date date, description_raw string, amount {MONEY}, direction string, currency string, "
        "category_id string, categorised_by string, is_deleted boolean, created_at string, updated_at string, source_category string, "
        "is_transfer boolean, transfer_group_id string, superseded_by string, dedup_layer string, statement_id string"
    ),
    "merchant_map": "id long, priority long, match_type string, pattern string, category_id string",
    "source_category_map": "id long, bank_code string, source_category string, category_id string",
    "rules": "id string, rule_seq long, priority long, is_system boolean, match_type string, value string, category_id string",
    "statements": "id string, statement_seq long, account_id string, bank_code string, period_start date, period_end date, needs_review boolean, source string, created_at string",
    "merchant_memory": "merchant_portion string, category_id string",
    "open_groups": f"amount {MONEY}, direction string",
}

#: Columns that an earlier schema version lacks, by the version that brought them; the others are of version 1.
ADDED_COLUMNS = {
    "transactions": {"source_category": 2, "is_transfer": 3, "transfer_group_id": 3, "superseded_by": 4, "dedup_layer": 4, "statement_id": 5},
    "accounts": {"last4": 6, "owner": 10},
    "statements": {"statement_seq": 9},
}
SCHEMA_VERSION = 10

#: Values that a column may hold besides null.
ENUMERATIONS = {
    "transactions": {"direction": (DEBIT, CREDIT), "categorised_by": (PERSON, PERSON_MEMORY, TRANSFER_DETECTOR, *STAGES), "dedup_layer": (CANONICAL, FUZZY)},
    "merchant_map": {"match_type": ("LITERAL", "REGEX")},
    "rules": {"match_type": ("KEYWORD", "REGEX", "AMOUNT_RANGE")},
    "statements": {"source": (STATEMENT, ALERT)},
    "categories": {"classification": ("SPEND", "INCOME", "TRANSFER", "INVESTMENT", "CC_PAYMENT", "REFUND")},
}

#: The default categories.
DEFAULT_CATEGORIES = (
    ("FOOD_AND_DINING", "Food & Dining", "SPEND"),
    ("GROCERIES", "Groceries", "SPEND"),
    ("TRANSPORT", "Transport", "SPEND"),
    ("FUEL", "Fuel", "SPEND"),
    ("SHOPPING", "Shopping", "SPEND"),
    ("ENTERTAINMENT", "Entertainment", "SPEND"),
    ("SUBSCRIPTIONS", "Subscriptions", "SPEND"),
    ("HEALTH_AND_MEDICAL", "Health & Medical", "SPEND"),
    ("EDUCATION", "Education", "SPEND"),
    ("UTILITIES", "Utilities", "SPEND"),
    ("RENT_EMI", "Rent / EMI", "SPEND"),
    ("INSURANCE", "Insurance", "SPEND"),
    ("INVESTMENTS", "Investments", "INVESTMENT"),
    ("SELF_TRANSFER", "Self Transfer", "TRANSFER"),
    ("CREDIT_CARD_BILL_PAYMENT", "Credit Card Bill Payment", "CC_PAYMENT"),
    ("TRAVEL", "Travel", "SPEND"),
    ("GIFTS_AND_DONATIONS", "Gifts & Donations", "SPEND"),
    ("SALARY_INCOME", "Salary / Income", "INCOME"),
    ("FREELANCE_INCOME", "Freelance Income", "INCOME"),
    ("CASHBACKS_AND_REFUNDS", "Cashbacks & Refunds", "REFUND"),
    ("REIMBURSEMENT", "Reimbursement", "REFUND"),
    ("SETTLE_UP", "Settle Up", "SPEND"),
    ("MISCELLANEOUS", "Miscellaneous", "SPEND"),
)


def default_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, True) for c in DEFAULT_CATEGORIES], TABLES["categories"])


def live(prefix: str = "") -> Column:
    """Rows that a person has: not deleted, and no duplicate of another row."""
    return (~F.col(f"{prefix}is_deleted")) & F.col(f"{prefix}superseded_by").isNull()


def unanswered(prefix: str = "") -> Column:
    return F.col(f"{prefix}category_id").isNull() & F.col(f"{prefix}categorised_by").isNull()


def engine_may_decide(prefix: str = "") -> Column:
    """Null must be named: in three-valued logic NOT IN alone would drop undecided rows."""
    by = F.col(f"{prefix}categorised_by")
    return by.isNull() | ~by.isin(PERSON, PERSON_MEMORY)


def not_by_hand(prefix: str = "") -> Column:
    return ~F.col(f"{prefix}categorised_by").eqNullSafe(F.lit(PERSON))


def signed_amount(amount: str = "amount", direction: str = "direction") -> Column:
    return F.when(F.col(direction) == DEBIT, -F.col(amount)).otherwise(F.col(amount))


def violations(table: DataFrame, name: str) -> DataFrame:
    """column, value and number of rows of values that the column may not hold."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(~F.col(c).isin(*allowed), F.col(c)).alias("value")) for c, allowed in ENUMERATIONS.get(name, {}).items()))
    bad = table.select(F.explode(cells.cast("array<struct<column:string,value:string>>")).alias("x")).where("x.value is not null")
    return bad.groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def version_of(columns: list[str], name: str) -> int:
    """The schema version that a table with these columns was written by, at least."""
    return max((v for c, v in ADDED_COLUMNS.get(name, {}).items() if c in columns), default=1)


def migrate(table: DataFrame, name: str) -> DataFrame:
    """A table of any earlier schema version brought to the present one; doing it again changes nothing."""
    kinds = dict(field.split(" ", 1) for field in TABLES[name].split(", "))
    new = {}
    for column, kind in kinds.items():
        if column not in table.columns:
            default = F.lit(False) if column in ("is_transfer", "is_deleted") else F.lit(None)
            new[column] = default.cast(kind)
    return table.withColumns(new).select(list(kinds)) if new else table.select(list(kinds))
