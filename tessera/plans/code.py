"""A code base made of the relational tables, so that the scanner, the detectors and the graph run on real sources.

Each customer is a script of one of five kinds, by market segment, that imports from the script of their nation;
box.js has one class. What the scripts say is fixed by the templates, so SQL over the tables tells what must be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import materialize, workers
from tessera.plans import services
from tessera.plans.standin import read

NATION = """let owner = null;
export let cache = make();
export function setOwner(t) { owner = t; }
export function getOwner() { return owner; }
export function reset() { cache = {}; }
export async function save(x) { return x; }
"""
BOX = """export class Box {
  constructor(c) { this.cache = c; }
}
"""
#: By segment: {k} is the customer's key, {n} the nation's.
CUSTOMER = {
    "BUILDING": """import { setOwner, getOwner, cache, save } from './n{n}.js';
import { Box } from './box.js';
let last{k} = 0;
const held = getOwner();
const box = new Box(cache);
export async function handle{k}(req) {
  last{k} = req.id;
  try { setOwner(req.t); await check(req); } catch (e) { log(e); }
  save(req);
}
""",
    "AUTOMOBILE": """import { save } from './n{n}.js';
el.addEventListener('click', onClick, { capture: true });
el.removeEventListener('click', onClick);
el.addEventListener('move', onMove);
export function isRich{k}(x) { return x.total > 18; }
async function safe(x) { await save(x); }
""",
    "MACHINERY": """const fs = require('fs');
export const items = [];
items.forEach((i) => { items.delete(i); grow(i); });
function grow(i) { items.add(i); }
fetch('/x');
export async function load{k}() { return await fetch('/y'); }
""",
    "HOUSEHOLD": """import React, { useState, useEffect } from 'react';
export function View{k}() {
  const [items, setItems] = useState([]);
  const opts = {};
  useEffect(() => { const t = setInterval(tick, 100); });
  useEffect(() => { load(); return () => stop(); }, [opts]);
  items.push(1);
  setItems([...items, 2]);
}
""",
    "FURNITURE": """/**
 * Keeps the orders of customer {k} in one place.
 */
export function order{k}(a, b) {
  const t = a + b;
  return () => t;
}
""",
}


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content). Customers are dealt out to all workers before their scripts are written: their table is one split, and a script is far longer than its row."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(workers(spark), "c_custkey")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = F.coalesce(*[F.when(F.col("c_mktsegment") == s, _filled(t, k=key, n=nation)) for s, t in CUSTOMER.items()])
    suffix = F.when(F.col("c_mktsegment") == "HOUSEHOLD", ".jsx").otherwise(".js")
    scripts = c.select(F.concat(F.lit("src/c"), key, suffix).alias("path"), text.alias("content"))
    nations = read(spark, d, "nation").select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(".js")).alias("path"), F.lit(NATION).alias("content"))
    box = spark.range(1).select(F.lit("src/box.js").alias("path"), F.lit(BOX).alias("content"))
    return scripts.unionByName(nations).unionByName(box)


_LOADED: dict[tuple, services.Project] = {}


def project(spark: SparkSession, d: str, make: Callable[[SparkSession, str], DataFrame] = files, kinds: frozenset[str] | None = None) -> services.Project:
    """The code base with its facts, of the kinds asked for at least. They are extracted once a session and table folder: queries share the written tables."""
    session = (spark.sparkContext.applicationId, d)
    for other in [k for k in _LOADED if k[:2] != session]:
        del _LOADED[other]
    key = (*session, f"{make.__module__}.{make.__name__}")
    had = [p for k, p in _LOADED.items() if k[:3] == key]
    for p in had:
        if p.kinds is None or kinds is not None and kinds <= p.kinds:
            return p
    loaded = services.load(had[0].files if had else materialize(make(spark, d)), kinds)
    _LOADED[(*key, kinds)] = loaded
    return loaded


def _text_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value}::VARCHAR)"
    return out


#: (path, seg, k, n) of the customers' scripts and (path, n) of the nations', for SQL.
FILES_SQL = """
f AS (SELECT 'src/c' || c_custkey || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '.jsx' ELSE '.js' END AS path, c_mktsegment AS seg, c_custkey AS k, c_nationkey AS n FROM customer),
g AS (SELECT 'src/n' || n_nationkey || '.js' AS path, n_nationkey AS n FROM nation)"""
#: (path, content) of all.
CONTENT_SQL = f"""{FILES_SQL},
code AS (
  SELECT path, CASE seg {" ".join(f"WHEN '{s}' THEN {_text_sql(t, k='k', n='n')}" for s, t in CUSTOMER.items())} END AS content FROM f
  UNION ALL SELECT path, {_text_sql(NATION)} FROM g UNION ALL SELECT 'src/box.js', {_text_sql(BOX)})"""
