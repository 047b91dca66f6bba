"""Frames and odd rows shared by the operator tests (the session comes from the common conftest)."""

SF001 = "/root/testdata/sf0.001"


def texts(spark, pairs, extra=False):
    """A documents frame from (doc_id, text) pairs; with ``extra``, columns whose names the operators use inside."""
    if not extra:
        return spark.createDataFrame(pairs, "doc_id long, text string")
    rows = [(i, t, "l", "s", len(t or ""), 1, b"x", 2, True) for i, t in pairs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, "
                                       "piece binary, n long, kept boolean")


#: null and empty texts, white space only, a null id, repeated rows, ties.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"),
       (None, "one two three"), (6, "a"), (7, "é中🙂 <|endoftext|> It's 42!! \x00 x")]
