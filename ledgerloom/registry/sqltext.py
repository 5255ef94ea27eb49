"""DuckDB texts of the same projections, shared by the check queries."""

from __future__ import annotations

from ..schema import CATEGORIES
from .fixtures import QUESTIONS

AS_OF = "DATE '2001-08-20'"
EVENT_DAY = "DATE '2024-01-20'"


def r(x: str, n: int = 2) -> str:
    """Decimal rounding, half up, free of float noise."""
    return f"CAST(CAST(CAST({x} AS DECIMAL(28,8)) AS DECIMAL(28,{n})) AS DOUBLE)"


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({x},'')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g'))"
    )


def mkey(x: str) -> str:
    return (
        f"array_to_string(list_slice(list_filter(string_split({norm(x)},' '), "
        "lambda t: regexp_matches(t,'[a-z]')),1,3),' ')"
    )


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def month(x: str) -> str:
    return f"strftime({x}, '%Y-%m')"


def payday_in(first: str, pay: str) -> str:
    return f"CAST({first} + CAST(least({pay}, day(last_day({first}))) - 1 AS INTEGER) AS DATE)"


def last_payday(d: str, pay: str) -> str:
    here = payday_in(f"CAST(date_trunc('month', {d}) AS DATE)", pay)
    before = payday_in(f"CAST(date_trunc('month', {d}) - INTERVAL 1 MONTH AS DATE)", pay)
    return f"(CASE WHEN {here} <= {d} THEN {here} ELSE {before} END)"


KEY = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))"
)

L = f"""L AS (
  SELECT CAST(c_nationkey AS BIGINT) AS user_id, {KEY} AS txn_key, CAST(l_shipdate AS DATE) AS txn_date,
    p_name || ' ' || CAST(l_orderkey AS VARCHAR) AS description, p_name, l_orderkey,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(p_retailprice AS DECIMAL(18,2)) AS flat_amount,
    CASE WHEN l_returnflag = 'R' THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'Uncategorised'
      WHEN p_type = 'ECONOMY' THEN 'Groceries' WHEN p_type = 'STANDARD' THEN 'Transport'
      WHEN p_type = 'SMALL' THEN 'Housing' WHEN p_type = 'MEDIUM' THEN 'Shopping'
      WHEN p_type = 'LARGE' THEN 'Dining Out' ELSE 'Cash Withdrawal' END AS category_name,
    CASE l_linenumber WHEN 1 THEN 'user' WHEN 2 THEN 'model' WHEN 3 THEN 'rule' ELSE 'default' END AS category_source,
    CASE l_linenumber WHEN 1 THEN 'manual-' || md5({KEY}) WHEN 2 THEN 'sync-momo-mtn-' || md5({KEY})
      WHEN 3 THEN 'sync-momo-airtel-' || md5({KEY}) WHEN 4 THEN 'sync-bank-' || md5({KEY})
      WHEN 5 THEN 'email-' || md5({KEY}) WHEN 6 THEN 'sync-momo-' || md5({KEY}) END AS import_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey)"""

N = """N AS (
  SELECT * EXCLUDE (description), CASE split_part(p_name, ' ', 2)
    WHEN 'widget' THEN 'Shoprite Manda Hill' WHEN 'bolt' THEN 'ZESCO Prepaid Units'
    WHEN 'gear' THEN 'Engen Great East Rd' WHEN 'ring' THEN 'NETFLIX.COM' WHEN 'plate' THEN 'KFC Cairo Road'
    WHEN 'anvil' THEN 'ATM WITHDRAWAL CAIRO RD' WHEN 'gizmo' THEN 'Airtel Money Transfer'
    ELSE 'Zzz Unknown Merchant' END || ' #' || CAST(l_orderkey AS VARCHAR) AS description FROM L)"""

C = "C AS (SELECT * FROM (VALUES " + ", ".join("('%s','%s')" % c for c in CATEGORIES) + ") AS t(category_name, category_type))"

P = """P AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name AS full_name,
  CAST(900000 AS DECIMAL(18,2)) AS salary_amount, CAST(40000 AS DECIMAL(18,2)) AS salary_credit,
  CAST(1 + (n_nationkey * 5) % 31 AS INTEGER) AS salary_day FROM nation)"""

GOALS = """GOALS AS (SELECT CAST(c_nationkey AS BIGINT) AS user_id, c_custkey AS goal_id,
  'goal ' || CAST(c_custkey AS VARCHAR) AS goal_name, CAST(15000 + c_acctbal AS DECIMAL(18,2)) AS target_amount,
  make_date(2001 + c_custkey % 6, 1 + c_custkey % 12, 15) AS target_date FROM customer)"""

RATES = """RATES AS (SELECT * FROM (VALUES (DATE '2024-01-01','ZMW','USD',0.04::DOUBLE),
  (DATE '2024-01-08','ZMW','USD',0.05::DOUBLE), (DATE '2024-01-20','ZMW','USD',0.04::DOUBLE),
  (DATE '2024-01-05','ZMW','EUR',0.032::DOUBLE)) AS t(as_of, base, code, per_local))"""

E = """E AS (SELECT user_id, CAST(event_id AS VARCHAR) AS txn_key, CAST(ts AS DATE) AS txn_date,
  event_type AS description, CAST(value AS DECIMAL(18,2)) AS amount,
  CASE WHEN event_type = 'signup' THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type, event_type AS category_name
  FROM events)"""

M = """M AS (SELECT user_id, '<evt-' || CAST(event_id AS VARCHAR) || '@example.com>' AS message_key,
  CAST(ts AS DATE) AS sent_on, event_id,
  CASE event_id % 3 WHEN 0 THEN 'Uber Receipts' WHEN 1 THEN 'Netflix' ELSE 'Weekly Deals' END AS sender_name,
  CASE event_id % 3 WHEN 0 THEN 'no-reply@uber.com' WHEN 1 THEN 'info@netflix.com' ELSE 'news@deals.example' END AS sender_addr,
  CASE event_id % 3 WHEN 0 THEN 'uber' WHEN 1 THEN 'netflix' END AS keyword,
  CASE event_id % 4 WHEN 0 THEN 'Your trip receipt' WHEN 1 THEN 'Invoice' WHEN 2 THEN 'News'
    ELSE 'Your free trial' END AS subject,
  CASE WHEN event_id % 7 = 0 THEN 'USD' WHEN event_id % 11 = 0 THEN 'GBP' END AS currency,
  CAST(CASE WHEN event_id % 5 <> 0 THEN value END AS DECIMAL(18,2)) AS amount
  FROM events)"""

B = """B AS (SELECT user_id, 'bank-' || CAST(event_id AS VARCHAR) AS txn_key,
  CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS txn_date,
  CASE event_id % 3 WHEN 0 THEN 'UBER *TRIP' WHEN 1 THEN 'NETFLIX.COM' ELSE 'ATM' END AS description,
  CASE event_id % 3 WHEN 0 THEN 'uber' WHEN 1 THEN 'netflix' END AS keyword,
  CAST(CASE WHEN event_id % 7 = 0 THEN CAST(value AS DECIMAL(18,2)) * CAST(25.75 AS DECIMAL(4,2))
    ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount, event_id AS bank_order
  FROM events)"""

_V = "(ceil(l_quantity / 10) * 1000 + 0.5)"
_PLAIN = f"CAST(CAST({_V} AS DECIMAL(18,2)) AS VARCHAR)"
_ISO = "strftime(l_shipdate, '%Y-%m-%d')"

S = f"""S0 AS (SELECT l_orderkey % 25 AS user_id, 'stmt-' || CAST(l_orderkey AS VARCHAR) AS file,
  l_linenumber * 10000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos,
  l_orderkey % 3 AS layout, l_returnflag = 'R' AS money_in,
  CASE l_partkey % 8 WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN 2 THEN strftime(l_shipdate, '%d/%m/%Y')
    WHEN 3 THEN strftime(l_shipdate, '%d %b %Y') WHEN 4 THEN {_ISO} || ' 10:15:00'
    WHEN 5 THEN strftime(l_shipdate, '%d-%m-%Y')
    WHEN 7 THEN CASE l_suppkey % 10 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '2062-01-01' WHEN 2 THEN '1985-01-05'
      ELSE {_ISO} END ELSE {_ISO} END AS date,
  CASE WHEN l_suppkey % 10 = 8 AND l_partkey % 8 = 0 THEN '  ' ELSE p_name END AS description,
  coalesce(CASE l_suppkey % 10 WHEN 0 THEN '-' WHEN 1 THEN 'K' || format('{{:,.2f}}', {_V})
    WHEN 2 THEN '(' || {_PLAIN} || ')' WHEN 3 THEN ' ZMW ' || {_PLAIN}
    WHEN 4 THEN CASE WHEN l_partkey % 3 = 0 THEN 'abc' ELSE {_PLAIN} END
    WHEN 5 THEN CASE WHEN l_partkey % 3 = 0 THEN '0' ELSE {_PLAIN} END
    WHEN 6 THEN CASE WHEN l_linenumber = 7 THEN '260977123456' ELSE {_PLAIN} END END,
    CASE WHEN l_returnflag = 'A' THEN '-' || {_PLAIN} ELSE {_PLAIN} END) AS raw_amount,
  CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN l_returnflag = 'R' THEN 'Credit' ELSE 'Debit' END
    WHEN 2 THEN CASE WHEN l_returnflag = 'R' THEN 'CR' ELSE ' dr ' END
    WHEN 3 THEN CASE WHEN l_suppkey % 10 = 9 THEN 'Transfer?' WHEN l_returnflag = 'R' THEN 'in' ELSE 'OUT' END
    ELSE CASE WHEN l_returnflag = 'R' THEN 'income' ELSE 'Payment' END END AS raw_type,
  l_suppkey, l_partkey, l_linenumber, l_returnflag,
  CAST({_V} AS DECIMAL(18,2)) AS value, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey),
S AS (SELECT user_id, file, pos, date, description, layout,
  CASE WHEN layout <> 1 THEN raw_amount END AS amount, CASE WHEN layout = 0 THEN raw_type END AS type,
  CASE WHEN layout = 1 THEN CASE WHEN money_in THEN '' ELSE raw_amount END END AS debit,
  CASE WHEN layout = 1 THEN CASE WHEN money_in THEN raw_amount ELSE '' END END AS credit FROM S0)"""


def parse_amount(x: str) -> str:
    t = f"trim({x})"
    bare = f"regexp_replace(trim({t}, '()'), 'ZMW|zmw|[, Kk]', '', 'g')"
    return (
        f"(CASE WHEN {t} IS NULL OR lower({t}) IN ('','nan','none','-') THEN NULL "
        f"WHEN starts_with({t},'(') AND ends_with({t},')') THEN -TRY_CAST({bare} AS DOUBLE) "
        f"ELSE TRY_CAST({bare} AS DOUBLE) END)"
    )


def parse_date(x: str) -> str:
    return (
        f"CAST(coalesce(try_strptime(left(trim({x}),10),'%Y-%m-%d'), try_strptime(left(trim({x}),10),'%Y/%m/%d'), "
        f"try_strptime(trim({x}),'%d/%m/%Y'), try_strptime(trim({x}),'%d-%m-%Y'), "
        f"try_strptime(trim({x}),'%d %b %Y')) AS DATE)"
    )


# Parsed statement rows with their reject reason; as-of 2001-08-20.
PARSED = f"""{S},
T0 AS (SELECT *, {parse_date('date')} AS txn_date, {parse_amount('amount')} AS a, {parse_amount('debit')} AS d,
  {parse_amount('credit')} AS c, lower(trim(coalesce(type,''))) AS token FROM S),
T1 AS (SELECT *,
  CASE WHEN layout = 1 THEN CASE WHEN coalesce(d,0) <> 0 THEN 'DEBIT' WHEN coalesce(c,0) <> 0 THEN 'CREDIT' END
    WHEN a IS NULL THEN NULL
    WHEN token IN ('credit','cr','c','deposit','in','income') THEN 'CREDIT'
    WHEN token IN ('debit','dr','d','withdrawal','out','expense','payment') THEN 'DEBIT'
    WHEN token <> '' THEN NULL WHEN a < 0 THEN 'DEBIT' ELSE 'CREDIT' END AS txn_type,
  CASE WHEN layout = 1 THEN abs(coalesce(nullif(d,0), nullif(c,0))) ELSE abs(a) END AS num,
  CASE WHEN layout = 1 THEN CASE WHEN coalesce(d,0) = 0 AND coalesce(c,0) = 0
      THEN 'Both debit and credit columns are empty' END
    WHEN a IS NULL THEN 'Amount is missing or not a number'
    WHEN token NOT IN ('','credit','cr','c','deposit','in','income','debit','dr','d','withdrawal','out','expense','payment')
      THEN 'Unrecognised transaction type ''' || token || '''' END AS type_reason FROM T0),
T AS (SELECT *, CASE
  WHEN txn_date IS NULL THEN 'Unreadable date'
  WHEN txn_date > {AS_OF} + 3 THEN 'Date ' || strftime(txn_date,'%Y-%m-%d') || ' is in the future'
  WHEN txn_date < {AS_OF} - 5478 THEN 'Date ' || strftime(txn_date,'%Y-%m-%d') || ' is more than 15 years old'
  WHEN trim(description) = '' THEN 'Description is blank'
  WHEN type_reason IS NOT NULL THEN type_reason
  WHEN num = 0 THEN 'Amount is zero'
  WHEN num > 100000000 THEN 'Amount exceeds the plausible maximum' END AS reject_reason FROM T1)"""

_Q = ", ".join("(%d, '%s')" % (i, q.replace("'", "''")) for i, q in enumerate(QUESTIONS))
Q = f"""QT AS (SELECT * FROM (VALUES {_Q}) AS t(idx, text)),
Q AS (SELECT conv_id, turn, conv_id % 25 AS user_id, QT.text FROM conversations
  JOIN QT ON QT.idx = (conv_id * 7 + turn * 3) % {len(QUESTIONS)})"""


def greedy(bank: str, candidates: str) -> str:
    """CTEs ending in PICK(user_id, bk, rid): bank rows, in their order, take the best free candidate.

    ``candidates`` names a relation (user_id, bk, ord, rid, pref). The state of an account is the list
    of what is taken; each step of the recursion is one bank row of every account.
    """
    return f"""{bank}BQ AS MATERIALIZED (SELECT user_id, bk, row_number() OVER (PARTITION BY user_id ORDER BY ord, bk) AS bi
  FROM (SELECT DISTINCT user_id, bk, ord FROM {candidates})),
CQ AS MATERIALIZED (SELECT BQ.user_id, bi, rid, pref FROM {candidates} c JOIN BQ ON BQ.user_id = c.user_id AND BQ.bk = c.bk),
NQ AS MATERIALIZED (SELECT user_id, max(bi) AS n FROM BQ GROUP BY ALL),
GQ AS (SELECT user_id, CAST(0 AS BIGINT) AS bi, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS rid FROM NQ
  UNION ALL
  SELECT user_id, bi, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p FROM (
    SELECT g.user_id, g.bi + 1 AS bi, any_value(g.taken) AS taken,
      arg_min(c.rid, c.pref) FILTER (NOT list_contains(g.taken, c.rid)) AS p
    FROM GQ g JOIN NQ ON NQ.user_id = g.user_id AND g.bi < NQ.n JOIN CQ c ON c.user_id = g.user_id AND c.bi = g.bi + 1
    GROUP BY g.user_id, g.bi)),
PICK AS (SELECT BQ.user_id, bk, rid FROM GQ JOIN BQ ON BQ.user_id = GQ.user_id AND BQ.bi = GQ.bi WHERE rid IS NOT NULL)"""
