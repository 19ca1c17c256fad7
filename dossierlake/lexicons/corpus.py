"""A small lexicon of words of the supplied corpus.

The corpus has no Korean text, so queries over it use these groups where the Korean
lexicon would never match. The operators take either.
"""

CORPUS_CHAPTERS = {
    "methods": ("thanedble", "eriner", "nicht"),
    "results": ("ertion", "erung", "oument"),
    "context": ("onble", "enheit", "mente"),
    "outlook": ("aning", "ouelle", "ciones"),
}

CORPUS_TAGS = {
    "ENGLISH": ("the", "thing", "attion", "thatin", "erble"),
    "FRENCH": ("que", "eaux", "ouier", "letre"),
    "GERMAN": ("nicht", "und", "erung", "keit"),
    "SPANISH": ("mente", "los", "que", "una"),
}
