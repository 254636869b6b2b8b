"""Registered queries of the counting operators, and their DuckDB SQL."""

from parallaxis.plans import measures, records, scene

QUERIES = {**scene.QUERIES, **records.QUERIES, **measures.QUERIES}
ORACLE = {**scene.ORACLE, **records.ORACLE, **measures.ORACLE}
