"""A small lexicon of our own transcriptions, for tests and as an example of the resource tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Words and their phonemes; TAG=phonemes entries separated by bars.
GOLD = """
the ðə|a ɐ|an ɐn|I ˈI|am ˈæm|to tˈu|in ˈɪn|of ʌv|and ænd|on ˈɔn|by bI|for fɔɹ|with wɪð|is ɪz|are ɑɹ|was wʌz|be bi|it ɪt|he hi|she ʃi|that ðæt|this ðɪs|from fɹʌm|as æz|or ɔɹ|not nˈɑt
at æt|plus plˈʌs|percent pəɹsˈɛnt|dot dˈɑt|slash slˈæʃ|minus mˈInəs|point pˈYnt|versus vˈɜɹsəs|dollar dˈɑləɹ|cent sˈɛnt|pound pˈWnd|pence pˈɛns|euro jˈʊɹO|walk wˈɔk|apple ˈæpᵊl|hello həlˈO|world wˈɜɹld
zero zˈɪɹO|one wˈʌn|two tˈu|three θɹˈi|four fˈɔɹ|five fˈIv|six sˈɪks|seven sˈɛvən|eight ˈAt|nine nˈIn|ten tˈɛn|eleven əlˈɛvən|twelve twˈɛlv|thirteen θɜɹtˈin|fourteen fɔɹtˈin|fifteen fɪftˈin|sixteen sɪkstˈin
seventeen sɛvəntˈin|eighteen Atˈin|nineteen nIntˈin|twenty twˈɛnti|thirty θˈɜɹti|forty fˈɔɹti|fifty fˈɪfti|sixty sˈɪksti|seventy sˈɛvənti|eighty ˈAti|ninety nˈInti|hundred hˈʌndɹəd|thousand θˈWzᵊnd|million mˈɪljən|billion bˈɪljən
first fˈɜɹst|second sˈɛkənd|third θˈɜɹd|fourth fˈɔɹθ|fifth fˈɪfθ|oh ˈO|A ˈA|B bˈi|C sˈi|D dˈi|E ˈi|F ˈɛf|G ʤˈi|H ˈAʧ|J ʤˈA|K kˈA|L ˈɛl|M ˈɛm|N ˈɛn|O ˈO|P pˈi|Q kjˈu|R ˈɑɹ|S ˈɛs|T tˈi|U jˈu|V vˈi|W dˈʌbᵊlju|X ˈɛks|Y wˈI|Z zˈi
"""


def lexicon(spark: SparkSession) -> DataFrame:
    entries = [e.split(" ") for line in GOLD.split("\n") for e in line.split("|") if e]
    rows = [("gold", w, {"DEFAULT": ps}) for w, ps in entries] + [("gold", "used", {"DEFAULT": "jˈuzd", "VBD": "jˈust"})]
    return spark.createDataFrame(rows, "tier string, word string, ps map<string,string>")
