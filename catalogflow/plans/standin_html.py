"""HTML / content stand-ins over ``documents`` (+ ``part``): every page holds
the *whole* document text in a paragraph, and fragments chosen by
``doc_id`` residues exercise each scorer branch.  One fragment spec renders
to both Spark columns and DuckDB SQL.

A fragment that is hard to read (a ">" in an attribute, character references)
has a plain twin that says the same.  The library reads ``html``; the oracles of
scores and texts read ``plain``, with simple patterns of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .standins import table

B = "{b}"  # placeholder for the product base name

# (modulus, residues, fragment[, plain twin]) in page order
FRAGMENTS = [
    (31, (0,), "```html\n"),
    (23, (0,), "<!DOCTYPE html><html><body>"),
    (7, (0,), '<H1 class="t">Titulo</H1>'),
    (7, (1,), "<!-- <h1>old</h1> -->"),
    # the six section keywords in order; out of order; three of them
    (4, (0,), f"<h2>{B}: para que serve</h2><p>a</p><h2>Entenda como funciona</h2><p>b</p><h2>Casos de contraindicação</h2>"
              f"<ul><li>c</li></ul><h2>Guia de como usar {B}</h2><h3>Dose</h3><p>d</p><h2>Composição por unidade</h2><p>e</p>"
              f"<h2>Tabela de especificações</h2>"),
    (4, (1,), f"<h2>Entenda como funciona</h2><p>b</p><h2>{B}: para que serve</h2><h2>Casos de contraindicação</h2>"
              f"<h2>Guia de como usar {B}</h2><h2>Composição por unidade</h2><h2>Tabela de especificações</h2>"),
    (4, (2,), f"<h2>{B}: para que serve</h2><h2>Guia de como usar {B}</h2><h2>Casos de contraindicação</h2>"),
    (4, (3,), "<h3>Sobre</h3><p>x</p>"),
    (3, (0,), "<ul><li>um</li></ul>"),
    (3, (1,), '<OL type="1"><li>dois</li></OL>'),
    (6, (0,), "<table><tr><th>Fabricante</th><td>Lab</td></tr><tr><td>Princípio Ativo</td><td>X</td></tr>"
              "<tr><td> Registro MS </td><td>1</td></tr></table>"),
    (6, (1,), "<table><tr><td>Fabricante</td><td>Lab</td></tr><tr><td>Princípio Ativo</td><td>X</td></tr></table>"),
    (6, (2,), "<table><tr><td>Fabricante</td></tr><tr><td>Princípio Ativo</td></tr><tr><td>Registro MS</td></tr>"
              "<tr><td>Validade</td></tr></table>"),
    (6, (3,), "<table data-x='a>b'><tr class=\"x > y\"><td title='a > b'>Fabricante</td><td>Lab</td></tr><tr><th>Princ&iacute;pio Ativo</th></tr>"
              "<tr><td data-y='<td>'>Registro&#32;MS</td></tr></table>",
     "<table><tr><td>Fabricante</td><td>Lab</td></tr><tr><th>Princípio Ativo</th></tr><tr><td>Registro MS</td></tr></table>"),
    (5, (0,), f'<div title="a > b" class="box faq-section"><div><details open><summary><h2>Dúvida um sobre {B}</h2></summary>'
              f"<p>r</p></details></div><details title='x > y' open><summary><h2 id='>'>Dúvida dois</h2></summary><p>r</p></details>"
              f"<details open><summary><h2>Dúvida três</h2></summary><p>r</p></details></div>",
     f'<div class="box faq-section"><div><details open><summary><h2>Dúvida um sobre {B}</h2></summary>'
     f"<p>r</p></details></div><details open><summary><h2>Dúvida dois</h2></summary><p>r</p></details>"
     f"<details open><summary><h2>Dúvida três</h2></summary><p>r</p></details></div>"),
    (5, (1,), '<div class="faq-section"></div><details><summary>late</summary></details>'),
    (5, (2,), '<div class="faq-section-x"><details><summary>q</summary></details></div>'),
    (5, (3,), "<h3 data-n='1 > 0'>D&uacute;vida um</h3>\n<p title='>'>r1</p><h3>Dúvida dois</h3> <p>r2</p>",
     "<h3>Dúvida um</h3>\n<p>r1</p><h3>Dúvida dois</h3> <p>r2</p>"),
    (8, (0, 1, 2), f'<div class="legal-notice-box"><p>{B}: seu uso PODE trazer riscos</p></div>'),
    (11, (0, 1, 2, 3, 4, 5), '<p class="transparency-note-final">Nota de transparência: fonte aprovada pela Anvisa</p>'),
    (11, (6,), '<p class="transparency-note-final">Nota de transpar&ecirc;ncia: fonte aprovada pela &#65;nvisa</p>',
     '<p class="transparency-note-final">Nota de transparência: fonte aprovada pela Anvisa</p>'),
    (11, (7,), '<p title="a > b" class="transparency-note-final">Nota de transpar&#234;ncia &#x2014; fonte aprovada pela Anvis&#x61; &copy &euro;&bogus;</p>',
     '<p class="transparency-note-final">Nota de transparência — fonte aprovada pela Anvisa © €&bogus;</p>'),
    (11, (8,), "<p>Nota de transpar&amp;ecirc;ncia sem Anvisa</p>"),
    (11, (0, 1, 2), "<p>Registro ANVISA 7 &amp; Fabricante Y</p>"),
    (11, (7,), "<p>Registro&nbsp;ANVISA 7 <b title='>'>&#70;abricante</b> Z, registro anvisa 8</p>",
     "<p>Registro\u00a0ANVISA 7 <b>Fabricante</b> Z, registro anvisa 8</p>"),
    (12, (5,), "<p title='<h1>' lang=\"pt\">x</p>", "<p>x</p>"),
    (13, (0,), '<A HREF="https://www.gov.br/anvisa">fonte</A>'),
    (13, (1,), '<a href="https://WWW.GOV.BR/x">up</a>'),
    (13, (2,), '<a title="gov.br" href="/x">t</a>'),
    (13, (3,), "<a class=x href='http://portal.gov.br'>s</a>"),
    (13, (4,), '<a title="x > y" href="https://www.gov.br/z">u</a>', '<a href="https://www.gov.br/z">u</a>'),
    (13, (5,), "<a title=\"href='https://www.gov.br'\" href=/v>v</a>", "<a href=/v>v</a>"),
    (17, (0,), '<script>var s="<h2>x</h2><ul>";</script><style>h1{color:red}</style>'),
    (None, None, "<p>{text}</p>"),
    (29, (0,), "<p>SEÇÃO 1</p>"),
    (23, (0,), "</body></html>"),
    (31, (0,), "\n```"),
]


def _spark_frag(frag: str) -> F.Column:
    parts = []
    for i, piece in enumerate(frag.split("{text}")):
        if i:
            parts.append(F.coalesce(F.col("text"), F.lit("")))
        for j, sub in enumerate(piece.split(B)):
            if j:
                parts.append(F.col("b"))
            if sub:
                parts.append(F.lit(sub))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_frag(frag: str) -> str:
    parts = []
    for i, piece in enumerate(frag.split("{text}")):
        if i:
            parts.append("coalesce(text, '')")
        for j, sub in enumerate(piece.split(B)):
            if j:
                parts.append("b")
            if sub:
                parts.append(_sql_lit(sub))
    return " || ".join(parts)


def _base_cols(d: DataFrame) -> DataFrame:
    b = F.concat(F.lit("Remedio"), F.upper(F.col("lang")))
    name = F.concat(b, F.lit(" "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("mg + 5mg"))
    return d.select("doc_id", "text", "lang", b.alias("b"), name.alias("product_name"))


def page_html(number) -> F.Column:
    """The page of the document with that number, over its ``text`` and ``b``."""
    pieces = []
    for mod, res, frag, *_ in FRAGMENTS:
        c = _spark_frag(frag)
        pieces.append(c if mod is None else F.when((number % mod).isin(*res), c).otherwise(F.lit("")))
    return (F.when(number % 19 == 0, F.lit(None).cast("string"))
             .when(number % 19 == 1, F.lit("")).otherwise(F.concat(*pieces)))


def made_html(spark, sf_dir) -> DataFrame:
    d = _base_cols(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "product_name", "b", page_html(F.col("doc_id")).alias("html"))


def made_content(spark, sf_dir) -> DataFrame:
    h = made_html(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    j = h.join(p, h["doc_id"] == p["p_partkey"], "inner")
    qty = (F.col("doc_id") % 60 + 1).cast("string")
    dose = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("mg ")))
    title = F.concat(F.col("b"), F.lit(" "), dose, F.col("p_brand"), F.repeat(F.lit(" Lab"), (F.col("doc_id") % 6).cast("int")),
                     F.lit(" "), qty, F.lit(" unidades"))
    desc = F.concat(F.col("b"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg - "), F.col("p_brand"),
                    F.lit(": caixa de "), qty, F.lit(" unidades, linha "), F.lower(F.col("p_type")),
                    F.repeat(F.lit(" econômica"), (F.col("doc_id") % 9).cast("int")),
                    F.when(F.col("doc_id") % 5 == 0, F.lit(". Há bula")).otherwise(F.lit("")),
                    F.when(F.col("doc_id") % 3 != 0, F.lit(". Encontre na nossa loja.")).otherwise(F.lit(".")))
    none = F.col("doc_id") % 41 == 0
    null = F.lit(None).cast("string")
    return j.select(
        "doc_id", "product_name",
        F.when(none | (F.col("doc_id") % 37 == 0), null).otherwise(title).alias("seo_title"),
        F.when(none, null).otherwise(desc).alias("meta_description"),
        F.when(none, null).otherwise(F.col("html")).alias("html_content"))


def _html_sql(plain: bool = False) -> str:
    parts = []
    for mod, res, frag, *twin in FRAGMENTS:
        s = _sql_frag(twin[0] if plain and twin else frag)
        if mod is None:
            parts.append(f"({s})")
        else:
            parts.append(f"(CASE WHEN doc_id % {mod} IN ({', '.join(map(str, res))}) THEN {s} ELSE '' END)")
    return " || ".join(parts)


SQL = {
    "made_html": f"""
SELECT doc_id, product_name, b,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN '' ELSE {_html_sql()} END AS html,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN '' ELSE {_html_sql(plain=True)} END AS plain
FROM (SELECT doc_id, text, lang, 'Remedio' || upper(lang) AS b,
             'Remedio' || upper(lang) || ' ' || CAST(doc_id % 90 + 10 AS VARCHAR) || 'mg + 5mg' AS product_name
      FROM documents)""",
    "made_content": """
SELECT doc_id, product_name,
  CASE WHEN doc_id % 41 = 0 OR doc_id % 37 = 0 THEN NULL ELSE
    b || ' ' || (CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || 'mg ' END) || p_brand
      || repeat(' Lab', CAST(doc_id % 6 AS INTEGER)) || ' ' || CAST(doc_id % 60 + 1 AS VARCHAR) || ' unidades' END AS seo_title,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE
    b || ' ' || CAST(p_size AS VARCHAR) || 'mg - ' || p_brand || ': caixa de ' || CAST(doc_id % 60 + 1 AS VARCHAR)
      || ' unidades, linha ' || lower(p_type) || repeat(' econômica', CAST(doc_id % 9 AS INTEGER))
      || (CASE WHEN doc_id % 5 = 0 THEN '. Há bula' ELSE '' END)
      || (CASE WHEN doc_id % 3 <> 0 THEN '. Encontre na nossa loja.' ELSE '.' END) END AS meta_description,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE html END AS html_content,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE plain END AS plain
FROM made_html JOIN (SELECT p_partkey, p_brand, p_type, p_size FROM part) p ON doc_id = p.p_partkey""",
}
