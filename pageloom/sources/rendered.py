"""Pages rendered from relational rows: what every kernel must make of them is known from the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a customer's page, in order; ``{...}`` are fields.
PAGE = (
    '<!doctype html><html><head><title>{name} | {nation}</title></head><body class="desk"><header><p>Customer desk of {nation}</p></header>'
    '<nav><ul><li><a href="/segments/{segment}">{segment}</a></li><li><a href="/nations/{key}">{nation}</a></li></ul></nav>'
    '<main id="card"><h1>{name}</h1><p>{first}</p>{more}<p>{last}</p></main><footer><p>Customer desk, all rights reserved</p></footer></body></html>'
)
FIRST = "The balance of {name} stood at {balance} when the desk last looked, and the desk looks every evening before it closes for the night."
LAST = "Orders from the {segment} segment are packed on the ground floor, and whoever comes in person finds the door of the desk open until six."
MORE = "Parcel {n} is still on its way to the quay."


def _filled(text: str, **fields: Column) -> Column:
    """A text with its fields filled in, as one concatenation."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), fields[name]]
    return F.concat(*out, F.lit(rest))


def customer_pages(customers: DataFrame, nations: DataFrame, extra: bool = False) -> DataFrame:
    """``page, host, url, at, html``: one page per customer of a known nation, its host the nation's.

    With ``extra`` a page has as many more paragraphs as its customer's number leaves over by three.
    """
    c, n = customers, nations
    name, nation, segment = F.col("c_name"), F.col("n_name"), F.col("c_mktsegment")
    times = (F.col("c_custkey") % 3).cast("int") if extra else F.lit(0)
    more = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), times), lambda i: i > 0), lambda i: F.concat(F.lit("<p>"), _filled(MORE, n=i.cast("string")), F.lit("</p>"))), "")
    balance = F.floor("c_acctbal").cast("bigint").cast("string")
    html = _filled(PAGE, name=name, nation=nation, segment=segment, key=F.col("n_nationkey").cast("string"), more=more, first=_filled(FIRST, name=name, balance=balance), last=_filled(LAST, segment=segment))
    host = F.concat(F.regexp_replace(F.lower(nation), "[^a-z0-9]", "-"), F.lit(".example"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 60)
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").cast("string").alias("page"), host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/customers/"), F.col("c_custkey").cast("string")).alias("url"), at.alias("at"), html.alias("html")
    )
