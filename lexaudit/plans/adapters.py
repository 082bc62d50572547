"""Legal tables derived from the given ones by fixed rules, each as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Numbered citations: seven digits with dots, of an order's key.
GROUPED = "concat(substr(n, 1, 1), '.', substr(n, 2, 3), '.', substr(n, 5, 3))"

#: Snippets with an identifier in several spellings, and the identifier.
SNIPPETS = f"""
SELECT o_orderkey AS doc_id, CASE o_custkey % 4
         WHEN 0 THEN concat('REsp ', replace(noisy, '.', ' '))
         WHEN 1 THEN concat('REsp ', noisy, '/SP')
         WHEN 2 THEN concat('Reclamação nº ', noisy, ' de 2019')
         ELSE concat('TRF1, RE ', noisy) END AS snippet, grouped
FROM (SELECT *, concat(substr(grouped, 1, 8), translate(substr(grouped, 9, 1), '05', 'OS')) AS noisy
      FROM (SELECT *, {GROUPED} AS grouped FROM (SELECT *, CAST(1000000 + o_orderkey AS VARCHAR(10)) AS n FROM orders) a) b) c
"""

#: Twenty-digit case numbers and their masks.
UNIFIED = """
SELECT doc_id, concat('processo ', a, b, '2020', '6', '16', c) AS snippet, concat(a, '-', b, '.2020.6.16.', c) AS masked
FROM (SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey AS VARCHAR(10)), 7, '0') AS a, lpad(CAST(o_custkey % 100 AS VARCHAR(10)), 2, '0') AS b, lpad(CAST(o_custkey % 9973 AS VARCHAR(10)), 4, '0') AS c FROM orders) x
"""

#: Texts that hold a number behind a filler of varying length.
PLACED = f"""
SELECT o_orderkey AS doc_id, concat(repeat('corpo ', CAST(o_custkey % 500 AS INT)), CASE o_orderkey % 3 WHEN 0 THEN grouped WHEN 1 THEN replace(grouped, '.', ' ') ELSE n END, ' fim') AS text,
       grouped AS identifier, 6 * (o_custkey % 500) + 1 AS expected
FROM (SELECT *, {GROUPED} AS grouped FROM (SELECT *, CAST(1000000 + o_orderkey AS VARCHAR(10)) AS n FROM orders) a) b
"""

#: Lines of orders by their key, one row each.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) lines"

#: Citations with what is known of them, for the decision rules.
CITATIONS = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS idx, concat('citation ', CAST(l_partkey AS VARCHAR(10))) AS snippet,
       CASE l_partkey % 4 WHEN 1 THEN 'especial' WHEN 2 THEN 'habeas' WHEN 3 THEN 'revista' END AS family,
       l_linenumber = 7 AS normative, CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN l_partkey END AS norm_id,
       CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE 1 END AS n_identifiers, l_suppkey % 7 = 0 AS ambiguous
FROM {LINES}
"""

#: Registry hits of those citations: none to four of each.
HITS = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS idx, (l_suppkey * 7 + j * (1 + l_partkey % 3)) % 50 + 1 AS record_id,
       CAST(1 + (l_partkey * 37 + j * (l_suppkey % 4) * (1 + l_orderkey % 2 * 700)) % 4000 AS INT) AS position,
       CASE (l_partkey + j) % 3 WHEN 0 THEN 'especial' WHEN 1 THEN 'habeas' ELSE 'revista' END AS family, (l_orderkey + j * l_partkey) % 3 = 0 AS files
FROM {LINES}, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t
WHERE j < (l_partkey + l_orderkey) % 5 AND l_suppkey % 11 <> 0 AND l_linenumber <> 7
"""

#: A registry of decisions: pairs of orders share a number, even ones state it in the header, odd ones far behind it.
REGISTRY = f"""
SELECT o_orderkey AS row_id, o_orderkey AS record_id, 'STJ' AS court, 'acordao' AS nature,
       concat('Vistos, relatados e discutidos. ', repeat('palavra ', CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 400 END), 'estes autos de Recurso Especial nº ', {GROUPED}, ' julgados.') AS text
FROM (SELECT *, CAST(1000000 + o_orderkey - o_orderkey % 2 AS VARCHAR(10)) AS n FROM orders) a
"""

#: Opinions that cite it: one paragraph a line, with a preamble; line 3 cites a number that no order has.
OPINION_CITES = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS line, asked, CASE l_linenumber % 2 WHEN 0 THEN concat('REsp ', {GROUPED}, '/SP') ELSE concat('Recurso Especial nº ', {GROUPED}) END AS snippet
FROM (SELECT *, CAST(asked AS VARCHAR(10)) AS n FROM (SELECT l_orderkey, l_linenumber, 1000000 + l_orderkey - l_orderkey % 2 + CASE WHEN l_linenumber = 3 THEN 8000000 ELSE 0 END AS asked FROM {LINES}) a) b
"""

#: Sentences with one citation of some form, or (snippet null) with a number that is none.
FORMS = """
SELECT doc_id, CASE k WHEN 1 THEN 'Segundo a ' WHEN 9 THEN 'conforme reiterados argumentos e o ' WHEN 16 THEN 'Também no ' WHEN 17 THEN 'Confira-se o ' WHEN 18 THEN 'Evidentemente a ' ELSE 'a parte recorrente invoca em seu favor o ' END AS before,
       CASE k WHEN 0 THEN concat('Súmula ', n, ' do STF') WHEN 1 THEN concat('5úmula Vinculante ', n) WHEN 2 THEN concat('Sum. ', n) WHEN 3 THEN concat('Tema 1.', n, ' da repercussão geral') WHEN 4 THEN concat('tema ', n)
         WHEN 5 THEN concat('art. ', n, ', II, do CPC') WHEN 6 THEN concat('artigo 1 ', n, ' do Código Civil') WHEN 7 THEN concat('art. 3º, § 2º, da Lei nº 9.', n, '/1995') WHEN 8 THEN concat('art. 41 do Decreto-Lei n.º 2.', n, '/1940')
         WHEN 9 THEN concat('julgado do STF proferido em ', y, ' pela relatoria de ', name) WHEN 10 THEN concat('acórdão da Segunda Turma do STJ, de ', y, ', Rel. Min. ', name) WHEN 11 THEN concat('entendimento firmado pelo TST em ', y)
         WHEN 12 THEN concat('acórdão do TRT da 15ª Região de ', y) WHEN 13 THEN concat('Reclamação do STF, de ', y, ', Rel. Min. ', name) WHEN 14 THEN concat('Agravo em Recurso Especial do STJ, de ', y, ', Rel. Min. ', name)
         WHEN 15 THEN concat('RMS de ', y, ', Rel. Min. ', name) WHEN 16 THEN concat('Recurso Especial nº l', n, 'O', n, '/SP') WHEN 17 THEN concat('Agravo Interno na Suspensão de Liminar e de Sentença nº 2.', n, '/MA') WHEN 18 THEN concat('Reclamação ', n, '/BA') END AS snippet,
       CASE k WHEN 19 THEN concat('prazo de ', n, ' dias') WHEN 20 THEN concat('CNPJ 12.', n, '.678/0001-90') WHEN 21 THEN concat('Protocolo nº 2023.', n) WHEN 22 THEN concat('Decreto ', n) WHEN 23 THEN concat('DJe de 14/3/', y) WHEN 24 THEN concat('Evento ', n)
         WHEN 25 THEN concat('Emenda Constitucional ', n) WHEN 26 THEN concat('Instrução Normativa ', n) WHEN 27 THEN 'reiterados precedentes do Superior Tribunal de Justiça' WHEN 28 THEN concat('Desconto de 1/', n) WHEN 29 THEN concat('R$ ', n, '.772,18') ELSE '' END
         || ', nos termos expostos acima' AS after
FROM (SELECT o_orderkey AS doc_id, o_orderkey % 30 AS k, CAST(100 + o_custkey % 900 AS VARCHAR(10)) AS n, CAST(1990 + o_custkey % 30 AS VARCHAR(10)) AS y, CASE o_custkey % 3 WHEN 0 THEN 'Herman Benjamin' WHEN 1 THEN 'MARIA DA PENHA' ELSE 'José de Souza Neto' END AS name FROM orders) x
"""

#: Gold citations, and predictions that miss, shift or mislabel some.
GOLD = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS line, CAST(l_linenumber * 100 AS INT) AS start, CAST(l_linenumber * 100 + 20 + l_partkey % 10 AS INT) AS "end",
       CASE l_suppkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END AS class, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey END AS record_id, CAST(1 + l_orderkey % 2 AS INT) AS level
FROM {LINES}
"""
PREDICTED = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS idx, CAST(l_linenumber * 100 + l_partkey % 15 AS INT) AS start, CAST(l_linenumber * 100 + l_partkey % 15 + 22 AS INT) AS "end",
       CASE (l_suppkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END AS class,
       CASE WHEN (l_suppkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 3 = 0 THEN l_partkey + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END END AS record_id,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_linenumber % 4 AS DOUBLE) / 4 END AS confidence,
       CASE l_linenumber % 4 WHEN 0 THEN 'especie' WHEN 1 THEN 'cabecalho' WHEN 2 THEN 'registro_unico' ELSE 'normativo' END AS path
FROM {LINES} WHERE l_suppkey % 10 <> 0
"""

#: A later revision of those predictions: the same spans and confidences with the classes and records of the gold citations, and the lines that the first one misses.
REVISED = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS idx, CAST(l_linenumber * 100 + l_partkey % 15 AS INT) AS start, CAST(l_linenumber * 100 + l_partkey % 15 + 22 AS INT) AS "end",
       CASE l_suppkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END AS class, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey END AS record_id,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_linenumber % 4 AS DOUBLE) / 4 END AS confidence
FROM {LINES}
"""

#: Normative records and citations of them, with misses and keys that several records have.
NORMS = """
SELECT p_partkey AS row_id, p_partkey AS record_id, 'STJ' AS court, CASE WHEN p_partkey % 2 = 0 THEN 'sumula' ELSE 'dispositivo' END AS nature,
       CASE WHEN p_partkey % 2 = 0 THEN concat('SÚMULA n. ', CAST(p_partkey % 150 AS VARCHAR(10)), ' do tribunal')
            ELSE concat('Art. ', CAST(p_size AS VARCHAR(10)), '. ', CASE p_partkey % 3 WHEN 0 THEN 'Todos são iguais perante a lei' WHEN 1 THEN 'a prisão preventiva poderá ser decretada' ELSE 'sem marca' END) END AS text
FROM part
"""
NORM_CITES = """
SELECT s_suppkey AS doc_id, 0 AS idx, CASE s_suppkey % 4 WHEN 0 THEN concat('Súmula ', CAST(s_suppkey % 170 AS VARCHAR(10)), ' do STJ')
         WHEN 1 THEN concat('art. ', CAST(s_suppkey % 60 AS VARCHAR(10)), ' da Constituição Federal') WHEN 2 THEN concat('artigo ', CAST(s_suppkey % 60 AS VARCHAR(10)), ' do CPP') ELSE concat('HC ', CAST(s_suppkey AS VARCHAR(10))) END AS snippet
FROM supplier
"""

#: Snippets that name families of appeals in several ways.
NAMED = """
SELECT p_partkey AS doc_id, CASE p_size % 12 WHEN 0 THEN 'Habeas Corpus nº 1' WHEN 1 THEN 'RHC 1.222' WHEN 2 THEN 'AgInt no AREsp 5' WHEN 3 THEN 'REspe 7' WHEN 4 THEN 'Mandado de Segurança' WHEN 5 THEN 'xMSx'
       WHEN 6 THEN 'AI-RR-5' WHEN 7 THEN 'Apelação' WHEN 8 THEN 'RE 5' WHEN 9 THEN 'nada' WHEN 10 THEN 'Recurso em sentido estrito' ELSE 'art. 5' END AS snippet, p_size
FROM part
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str, dealt: str | None = None) -> DataFrame:
    """A derived table: sql over the named given tables.

    dealt: a column by which the given rows are dealt out and sorted first, so
    that long texts derived from a small file are made in many tasks, and are
    joined by that column where they are made.
    """
    text = sql.replace('"end"', "`end`")
    given = {n: table(spark, sf_dir, n) for n in names}
    if dealt is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        given = {n: t.repartition(parts, dealt).sortWithinPartitions(dealt) for n, t in given.items()}
    return spark.sql(_with_arguments(text, names), **given)


def _with_arguments(sql: str, names: tuple[str, ...]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", sql)
    return sql
