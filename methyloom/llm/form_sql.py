"""The consistent form, words and passages of texts in DuckDB's SQL, built from the same rule character by character."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from .unicode_form import INVISIBLE, LOOKALIKES, TOP, char_form


@lru_cache(1)
def _changed() -> str:
    """VALUES of the characters whose form is not their canonical decomposition; invisible ones are not among them."""
    rows = []
    for cp in range(0x20, TOP):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co") or any(a <= cp <= z for a, z in INVISIBLE):
            continue
        form = char_form(ch)
        if form != unicodedata.normalize("NFD", ch):
            rows.append("(" + f"chr({cp}), " + " || ".join(f"chr({ord(c)})" for c in form) + ")")
    rows += [f"(chr({cp}), chr({ord(char_form(chr(cp)))}))" for cp in (0x9, 0xB, 0xC, 0xD, 0x85)]
    return ", ".join(rows)


def forms(table: str, ident: str, text: str = "text") -> str:
    """CTEs that end in ``<table>_form``: ``ident`` and ``form`` of the non-null texts of ``table``."""
    gone = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in INVISIBLE if a) + "]"
    return f"""{table}_map(c, r) AS (VALUES {_changed()}),
      {table}_chars AS (SELECT {ident}, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM (SELECT {ident}, regexp_extract_all(regexp_replace({text}, '{gone}', '', 'g'), '(?s).') AS c FROM {table} WHERE {text} IS NOT NULL)),
      {table}_some AS (SELECT {ident}, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)) AS form FROM {table}_chars LEFT JOIN {table}_map USING (c) GROUP BY 1),
      {table}_form AS (SELECT {ident}, coalesce(form, '') AS form FROM (SELECT {ident} FROM {table} WHERE {text} IS NOT NULL) LEFT JOIN {table}_some USING ({ident}))"""


def words(table: str, ident: str) -> str:
    """CTE ``<table>_word``: ``ident``, ``i`` (from 0), ``w``: the words of ``<table>_form`` without case."""
    twins = {a.lower(): b.lower() for a, b in LOOKALIKES.items()}
    twins = {a: b for a, b in twins.items() if len(a) == 1}
    low = f"translate(lower(form), '{''.join(twins)}', '{''.join(twins.values())}')"
    return f"""{table}_word AS (SELECT {ident}, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (SELECT {ident}, regexp_extract_all({low}, '[\\pL\\pN\\pM]+') AS w FROM {table}_form))"""


def passages(least: int = 12) -> str:
    """CTE ``passage``: doc_id, item_id, words, at_word of the longest common passage of each document and item."""
    grams = ", ".join(f"""{t}_gram AS (SELECT {k}, i, array_to_string(list(w) OVER g, ' ') AS g FROM {t}_word
      WINDOW g AS (PARTITION BY {k} ORDER BY i ROWS BETWEEN CURRENT ROW AND {least - 1} FOLLOWING) QUALIFY count(*) OVER g = {least})""" for t, k in (("documents", "doc_id"), ("eval_items", "item_id")))
    return f"""{forms("documents", "doc_id")}, {forms("eval_items", "item_id")}, {words("documents", "doc_id")}, {words("eval_items", "item_id")}, {grams},
      hit AS (SELECT doc_id, item_id, d.i AS place, d.i - e.i AS diagonal FROM documents_gram d JOIN eval_items_gram e USING (g)),
      run AS (SELECT doc_id, item_id, min(place) AS place, count(*) + {least - 1} AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY place) AS r FROM hit) GROUP BY doc_id, item_id, diagonal, r),
      passage AS (SELECT doc_id, item_id, CAST(n AS INT) AS words, CAST(place AS INT) AS at_word FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, place) = 1)"""
