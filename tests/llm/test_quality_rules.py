"""The quality rules: filters on the verdict, and lines in four languages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quire.llm import quality_rules

PROSE = {
    "en": "the council met on friday and spoke about the new bridge over the river for a long while.",
    "fr": "le conseil s'est réuni vendredi et a parlé longtemps du nouveau pont sur la rivière de la ville.",
    "de": "der rat kam am freitag zusammen und sprach lange über die neue brücke über den fluss der stadt.",
    "es": "el consejo se reunió el viernes y habló mucho tiempo del nuevo puente sobre el río de la ciudad.",
}
FURNITURE = {
    "en": ["Home", "All rights reserved."],
    "fr": ["Accueil", "Tous droits réservés.", "NOUS UTILISONS DES COOKIES, VOIR LES DÉTAILS ici.", "À propos"],
    "de": ["Zurück", "Alle Rechte vorbehalten.", "Wir verwenden Cookies.", "Über uns"],
    "es": ["Menú", "Todos los derechos reservados.", "Haz clic aquí para ver más.", "Iniciar sesión"],
}


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit((PROSE["en"] + "\n") * 3), F.col("id").cast("string"), F.lit("\nHome")).alias("text"))


def test_filters_on_the_verdict_cost_no_more_than_the_report(many):
    start = time.time()
    report = quality_rules.quality_rules(many).agg(F.count_if("kept"), F.count("clean_text")).first()
    plain = time.time() - start
    start = time.time()
    kept = quality_rules.quality_rules(many).where("kept").where("n_words > 1 and not base_failed").agg(F.count("clean_text")).first()
    assert kept[0] == report[0]
    assert time.time() - start < 5 * plain + 5


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_furniture_lines_go_in_every_language(spark, lang):
    body = [f"{PROSE[lang]} {i} {PROSE[lang]}" for i in range(3)]
    df = spark.createDataFrame([(1, "\n".join([*FURNITURE[lang], *body]))], "doc_id long, text string")
    row = quality_rules.quality_rules(df).first()
    assert row["clean_text"] == "\n".join(body) and row["n_bad_lines"] == len(FURNITURE[lang])
