"""Small hand-made documents with the awkward cases every operator must take."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "shard string, score double, n_words long, epoch int, id long, in0 string, key string")

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion near the old stone bridge"
LONG = " ".join(f"word{i % 997} Ünïcode{i % 89}" for i in range(60_000))


def documents(spark):
    def row(i, text, lang="en", source="src0"):
        return (i, text, lang, source, None if text is None else len(text), "s", 0.5, 7, 1, 3, "x", "k")

    rows = [row(1, PROSE), row(2, PROSE), row(2, PROSE), row(2, PROSE + " and more"), row(None, PROSE),
            row(None, None), row(3, None), row(4, ""), row(5, "  \t\n "), row(6, "12345 !!! 67"),
            row(7, LONG), row(8, "Straße " * 50, "de", None), row(9, "la maison bleue est près du lac", None, "src9"),
            row(10, "one"), row(10, "one"), row(11, PROSE.upper()), row(12, "Straße " * 50, "de", "src3")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
