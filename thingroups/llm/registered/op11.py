"""op11: the phrases of each language that stand out most."""

from thingroups.llm import collocations
from thingroups.llm.common import table
from thingroups.llm.queries import register

SQL = """
WITH pieces AS (
  SELECT doc, lang, unnest(list) AS piece, generate_subscripts(list, 1) AS number FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]') AS list
    FROM documents)
), words AS (
  SELECT doc, lang, number, unnest(list) AS word, generate_subscripts(list, 1) AS place FROM (
    SELECT doc, lang, number, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS list FROM pieces)
), runs AS (
  SELECT lang, word AS p1, p1 || ' ' || lead(word, 1) OVER o AS p2, p2 || ' ' || lead(word, 2) OVER o AS p3,
    p3 || ' ' || lead(word, 3) OVER o AS p4, p4 || ' ' || lead(word, 4) OVER o AS p5
  FROM words WINDOW o AS (PARTITION BY doc, number ORDER BY place)
), counts AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest([p1, p2, p3, p4, p5]) AS phrase FROM runs) WHERE phrase IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, count(*) AS n FROM runs GROUP BY 1
), often AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, f FROM counts WHERE f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    (1000 * c.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM often WHERE len(w) > 1) c
  JOIN totals t ON t.lang = c.lang
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS f FROM (
    SELECT *, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM often WHERE len(w) > 2))
  WHERE j - i + 1 < len(w) GROUP BY ALL
)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank, o.phrase, a, l, r,
  n, score::BIGINT AS score
FROM lowest o LEFT JOIN inner_phrases i ON i.lang = o.lang AND i.phrase = o.phrase
WHERE i.f IS NULL OR 100 * i.f < 100 * a
QUALIFY rank <= 2000
"""


@register("op11_collocations", SQL)
def op11(spark, sf_dir):
    return collocations.report(table(spark, sf_dir, "documents"))
