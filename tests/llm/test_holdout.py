"""Residue and prose kept out of seeds and fitting, prose on other matters than the documents: recall and precision."""

import os
import re

import pytest

from beliefloom.llm import residue as R

RESIDUE = [
    "Whoops! That page doesn't exist anymore.\nTry our home page instead.",
    "HTTP ERROR 502\nThe web server reported a bad gateway error.",
    "We're sorry, but this document could not be located on the server.",
    "The website is currently unavailable. Please check again in an hour.",
    "Internal error. The operation failed unexpectedly; please retry your request.",
    "403 - Forbidden\nYou don't have the required permission for this directory.",
    "Connection timed out. The database server could not be reached.",
    "Traceback (most recent call last):\n  File \"serve.py\", line 88, in view\nRuntimeError: no response",
    "You must turn on JavaScript in your browser to use this page.",
    "This page requires scripts. Enable JavaScript and refresh.",
    "Your browser blocks scripts. Please allow JavaScript for this site and reload the page.",
    "Bitte aktivieren Sie Scripts im Browser, um den Inhalt anzuzeigen.",
    "Die Seite ist vorübergehend nicht erreichbar. Bitte laden Sie sie später neu.",
    "Cette page n'est pas disponible. Veuillez réessayer plus tard.",
    "Esta página no está disponible. Vuelva a intentarlo en unos minutos.",
    "Lorem ipsum dolor sit amet.\nDuis aute irure dolor in voluptate velit esse fugiat.",
    "Sed ut labore et dolore magna, quis nostrud commodo consequat ut enim minim.",
    "Your headline here.\nAdd your own text here and describe your topic.",
    "Sample text. Replace it with your content.",
    "bla bla bla bla\ntest test test",
    "Blindtext: Hier steht später Ihr Text.",
    "Texte d'exemple. Ajoutez votre contenu ici.",
    "Texto de ejemplo. Escriba aquí su contenido.",
    "Dear {{ customer }}, your parcel has been sent.",
    "Invoice for [INSERT COMPANY]\nThe sum is due within thirty days.",
    "The meeting of ${committee} was moved to the second week of May.",
    "Signed on %s in the presence of the harbour pilot.",
    "Please send the answer to <<MANAGER>> before the end of the week.",
    "Report of @@office@@ on the state of the pumps.",
    "Contact: [your phone here]. The desk answers on weekdays.",
]
PROSE = [
    "The pilot found the lock gate open and noted the level, which had fallen by two feet since the morning.",
    "Our correspondent could not find the page in the register, so the clerk looked for it in the older volume.",
    "The server room was cooled by water from the canal until the pump failed in August.",
    "She was denied access to the archive because the permit had expired the week before.",
    "He tried again later and the valve opened without further trouble.",
    "The words \"Service Unavailable\" stood on the screen for an hour, the operator told the committee.",
    "A notice on the door said that the office was closed for repair.",
    "The script of the play was enabled by a grant from the town, and cookies were served after the reading.",
    "The printer used a passage of pseudo-Latin, lorem ipsum and so on, to show the typeface to the editor.",
    "In the manual the token `{{ customer }}` marks the place where the name is printed.",
    "```\nprint(f\"{name} {value}\")\n```\nThe listing shows how the name is set before the letter is sent.",
    "> Dear {{ customer }}\nThe quotation above is how the letter began before the name was filled in.",
    "Der Bericht nennt die Seite, auf der die Messwerte nicht gefunden werden konnten, und den Namen des Prüfers.",
    "Le rapport a été remis en mai, puis corrigé après la visite de l'ingénieur à l'écluse.",
    "El informe se entregó en mayo y fue corregido tras la visita del ingeniero a la esclusa.",
    "The error in the gauge was traced to a loose wire, and the temporary repair held until spring.",
    "Requests for copies rose to forty in one week; the limit set by the registry is fifty.",
    "The test of the new text took three weeks, since each sample had to be read twice.",
    "Page 404 of the ledger was missing, which the auditor put down to a careless binder.",
    "The engineer [sic] wrote that 5 % of the readings (see table 2) were not usable.",
]


@pytest.fixture(scope="module")
def found(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = [(f"bad{i}", t) for i, t in enumerate(RESIDUE)] + [(f"good{i}", t) for i, t in enumerate(PROSE)]
    corpus = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id AS string) AS id", "text")
    model = R.fit(corpus, "id", "text")
    got = R.residue(spark.createDataFrame(docs, "id string, body string"), "id", "body", model=model)
    return {r.id for r in got.where("residue").collect()}


def test_recall(found):
    missed = [t for i, t in enumerate(RESIDUE) if f"bad{i}" not in found]
    assert len(missed) <= 0.1 * len(RESIDUE), missed


def test_precision(found):
    wrong = [t for i, t in enumerate(PROSE) if f"good{i}" in found]
    assert len(wrong) <= 0.2 * len(PROSE), wrong


def test_hardly_any_seed_stands_in_the_documents(spark, sf):
    """The seeds are general text: no more than a few of their sentences stand in the test documents."""
    texts = "\n".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").collect())
    seeds = [x.strip() for part in (R.FILLER, R.NOTICE) for line in part.splitlines() for x in re.split(r"(?<=[.!?])\s", line) if len(x.strip()) >= 18]
    assert sum(x in texts for x in seeds) <= 0.05 * len(seeds)
