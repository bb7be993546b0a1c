"""What leaves the index: allow-listed records, one-line briefs, export blocks, and the tools that give them."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import FENCE, clean, one_line, present, skip_reason, text
from kinfold.plans.search import MOST, clamp, search, stats, top_domains, within
from kinfold.schema import SERVED

PROTOCOL, FRAME = "2025-06-18", 1 << 20


def _show(c: Column) -> Column:
    return clean(c, 500)


def _joined(a: Column, k: int | None = None) -> Column:
    return F.array_join(F.slice(a, 1, k) if k else a, ", ")


def _some(a: Column) -> Column:
    return F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0


def attested_served() -> Column:
    """Without the real name, which stays with the owner."""
    a = F.col("attested")
    fields = ("relationship", "context", "domains", "location", "corroboration")
    return F.when(a.isNotNull(), F.struct(*(F.when(_some(a[f]) if f == "domains" else present(a[f]), a[f]).alias(f) for f in fields)))


def enrichment_served() -> Column:
    """Without the notes where they argue for a claim that was refused."""
    e, u = F.col("enrichment"), F.col("unconfirmed")
    refused = F.coalesce(present(u["employer"]) | present(u["profession"]), F.lit(False))
    return F.when(e.isNotNull(), F.struct(e["confidence"].alias("confidence"), text(e["enrichedAt"]).alias("enrichedAt"), F.when(~refused, text(e["notes"])).alias("notes")))


def cleaned(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.when(c.isNotNull(), clean(c, 4000))
    if kind == "array<string>":
        return F.transform(c, lambda x: clean(x, 4000))
    if kind == "map<string,string>":
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(clean(e["key"], 200), clean(e["value"], 4000))))
    return c


def served(people: DataFrame) -> DataFrame:
    """The allow-listed fields, cleaned; what is not listed never rides along."""
    kinds = dict(people.dtypes)
    whole = people.withColumns({"attested": attested_served(), "enrichment": enrichment_served()})
    inner = dict(whole.select("attested.*").dtypes), dict(whole.select("enrichment.*").dtypes)
    nested = [F.when(F.col(c).isNotNull(), F.struct(*(cleaned(F.col(c)[f], k).alias(f) for f, k in own.items()))).alias(c) for c, own in zip(("attested", "enrichment"), inner, strict=True)]
    return whole.select(*(cleaned(F.col(f), kinds[f]).alias(f) for f in SERVED if f in kinds), *nested)


def brief() -> Column:
    """A person in one line."""
    prof = F.concat_ws(" @ ", F.nullif(text(F.col("profession")), F.lit("")), F.nullif(text(F.col("employer")), F.lit("")))
    reach = F.array_join(F.filter(F.concat(F.slice("emails", 1, 1), F.array("linkedinUrl")), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    maybe = lambda c, head="": F.when(present(c), F.concat(F.lit(head), _show(c)))
    or_none = lambda c: F.when(present(c), _show(c)).otherwise("(none)")
    return F.concat_ws(
        " | ", _show(F.col("name")), maybe(prof), maybe(F.col("location")), maybe(F.col("attested.relationship"), "relationship: "),
        F.when(_some(F.col("domains")), F.concat(F.lit("expertise: "), _show(_joined(F.col("domains"), 8)))), F.when(_some(F.col("labels")), F.concat(F.lit("labels: "), _show(_joined(F.col("labels"), 6)))),
        maybe(reach), F.concat(F.lit("sources: "), or_none(F.array_join("sources", ","))), F.concat(F.lit("confidence: "), _show(F.coalesce("confidence", F.lit("none")))), F.concat(F.lit("key: "), or_none(F.get("keys", F.lit(0)))),
    )


def export_block() -> Column:
    """A person as a paragraph for a knowledge file."""
    entries = lambda c, f: F.transform(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key string,value string>>")), f)
    contact = F.concat(F.slice("emails", 1, 2), entries("handles", lambda e: F.concat(e["key"], F.lit(" @"), e["value"])), F.array("linkedinUrl"))
    contact = F.array_join(F.filter(contact, lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    connected = F.array_join(entries("connectedOn", lambda e: F.concat(e["key"], F.lit(" "), e["value"])), "; ")
    maybe = lambda c, head="": F.when(present(c), F.concat(F.lit(head), c))
    prof = F.concat_ws(" at ", F.nullif(text(F.col("profession")), F.lit("")), F.nullif(text(F.col("employer")), F.lit("")))
    parts = F.concat_ws(
        ". ", maybe(prof), maybe(F.col("location"), "location: "), maybe(F.col("attested.relationship"), "relationship: "), maybe(F.col("attested.context")),
        maybe(_joined(F.col("domains")), "expertise: "), maybe(_joined(F.col("labels")), "labels: "), maybe(contact, "contact: "), maybe(F.col("notes")), maybe(connected, "connected: "),
    )
    return F.when(one_line(parts) == "", "(no details yet)").otherwise(one_line(parts))


def knowledge(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(blocks(first_ord, name, heading, block), skipped(reason, n))``."""
    rows = people.withColumn("reason", skip_reason(F.col("name")))
    blocks = rows.where("reason is null").select("first_ord", "name", F.concat(F.lit("## "), one_line(F.col("name"))).alias("heading"), export_block().alias("block"))
    return blocks, rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def write_knowledge(people: DataFrame, path: str, day: str) -> int:
    """The knowledge file, in order of name; rows come to the driver one partition at a time."""
    from kinfold.sources.overlays import replace_file

    blocks, _ = knowledge(people)
    n = blocks.count()
    ordered = blocks.orderBy(F.collate("name", "UNICODE"), "first_ord")

    def lines() -> Iterator[str]:
        yield f"# People\n\n{n} contacts, exported {day}.\nEach entry: who they are, what they do, how the owner knows them.\n"
        for row in ordered.toLocalIterator():
            yield f"\n{row['heading']}\n{row['block']}\n"

    replace_file(path, lines())
    return n


# -- tools ------------------------------------------------------------------------------------


def _fenced(body: str) -> str:
    return f"{FENCE[0]}\n{body}\n{FENCE[1]}"


def _ordered(people: DataFrame, n: int) -> list:
    return people.orderBy(F.collate("name", "UNICODE"), "first_ord").limit(n).select(brief().alias("b")).collect()


def search_contacts(people: DataFrame, args: dict) -> str:
    limit = clamp(args.get("limit"))
    given = {k: str(args[k]) for k in ("domain", "employer", "location") if args.get(k)}
    query = str(args.get("query") or "")
    if not query and not given:
        raise ValueError("give at least one of: query, domain, employer, location")
    hits = search(people, query, **given)
    n = hits.count()
    if not n:
        return "No matches."
    more = f" (showing {limit})" if n > limit else ""
    return _fenced(f"{n} match(es){more}:\n\n" + "\n".join(r["b"] for r in _ordered(hits, limit)))


def _record(person: DataFrame) -> str:
    row = served(person).limit(1).select(F.to_json(F.struct("*"))).first()
    return json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)


def get_contact(people: DataFrame, args: dict) -> str:
    said = lambda s: re.sub(r"[\x00-\x1f\x7f-\x9f]+", " ", str(s))[:500]
    if args.get("key"):
        hit = people.where(F.array_contains("keys", str(args["key"])))
        return _fenced(_record(hit)) if hit.limit(1).count() else f'No contact with key "{said(args["key"])}".'
    name = str(args.get("name") or "").lower().strip()
    if not name:
        raise ValueError("give a name or a key")
    hits = people.where(within(F.col("name"), name))
    n = hits.count()
    if n == 0:
        return f'No contact matching "{said(args["name"])}".'
    if n == 1:
        return _fenced(_record(hits))
    more = f"\n(+{n - MOST} more)" if n > MOST else ""
    rows = "\n".join(r["b"] for r in _ordered(hits, MOST))
    return _fenced(f'{n} contacts match "{said(args["name"])}". Narrow the name, or ask again with one of these keys:\n{rows}{more}')


def contact_stats(people: DataFrame, args: dict) -> str:
    rows = stats(people).where("kind <> 'domain'").collect()
    of = lambda kind: json.dumps({r["value"]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], str(r["value"]))) if r["kind"] == kind})
    top = ", ".join(f"{r['value']}: {r['n']}" for r in top_domains(people).collect())
    return "\n".join((f"{people.count()} contacts.", f"Tiers: {of('tier')}", f"Sources: {of('source')}", f"Confidence: {of('confidence')}", f"Top domains: {top or '(none yet)'}"))


TOOLS: dict[str, Callable[[DataFrame, dict], str]] = {"search_contacts": search_contacts, "get_contact": get_contact, "contact_stats": contact_stats}
_TEXT = {"type": "string"}
_INPUT = {"search_contacts": {"query": _TEXT, "domain": _TEXT, "employer": _TEXT, "location": _TEXT, "limit": {"type": "number"}}, "get_contact": {"name": _TEXT, "key": _TEXT}, "contact_stats": {}}


def handle(message: object, load: Callable[[], DataFrame]) -> dict | None:
    """The answer to one JSON-RPC message; none to a notification. ``load`` reads the index anew for every call."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0":
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "one request at a time"}}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "kinfold", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p}} for n, p in _INPUT.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    try:
        if params.get("name") not in TOOLS:
            raise ValueError(f"unknown tool: {params.get('name')}")
        return reply | {"result": {"content": [{"type": "text", "text": TOOLS[params["name"]](load(), params.get("arguments") or {})}]}}
    except (ValueError, OSError) as e:
        return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}


def serve(load: Callable[[], DataFrame], source=sys.stdin, sink=sys.stdout) -> None:
    """Answer newline-delimited messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            if len(line.encode()) > FRAME:
                raise ValueError("too long")
            answer = handle(json.loads(line), load)
        except ValueError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
            sink.flush()
