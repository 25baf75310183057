"""JSON operation bodies to the common (author, voter, permlink, rshares) shape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles below this are exact whole numbers.
_EXACT = 2**53


def _text(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$[0].{field}", "string")


def _weight(value: Column) -> Column:
    """The weight as text; a number with an exponent as the whole number it is, where a double holds it exactly."""
    path = "$[0].rshares"
    number = F.try_variant_get(value, path, "double")
    exact = (F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "DOUBLE") & (F.abs(number) < _EXACT) & (number % 1 == 0)
    return F.when(exact, number.cast("long").cast("string")).otherwise(_text(value, "rshares"))


def _parsed(ops: DataFrame, *columns) -> DataFrame:
    """The given columns, the body fields as text (the weight may be a JSON number or a JSON string) and `broken`, which
    says that the body is not one JSON object and nothing else.

    The parser stops behind the first value. So the body becomes the first of two values of an array, of which the second is
    a number that no text can foresee in itself: a body with more behind its object, or with several, loses the array or
    its second value. The generator keeps later filters and joins on the fields from being pushed below it, so every body is
    parsed exactly once.
    """
    mark = F.xxhash64("body_value")
    array = F.try_parse_json(F.concat(F.lit("["), F.col("body_value"), F.lit(","), mark.cast("string"), F.lit("]")))

    def fields(value: Column) -> Column:
        alone = (F.try_variant_get(value, "$[1]", "long") == mark) & F.try_variant_get(value, "$[2]", "variant").isNull()
        whole = alone & F.ltrim(F.translate("body_value", "\n\r\t", "   ")).startswith("{")
        return F.struct(
            _text(value, "author").alias("author"), _text(value, "voter").alias("voter"), _text(value, "permlink").alias("permlink"),
            _weight(value).alias("rshares"), (~F.coalesce(whole, F.lit(False))).alias("broken"))

    return ops.select(*columns, F.inline(F.transform(F.array(array), fields)))


def _whole(parsed: DataFrame) -> DataFrame:
    """A broken body is an error. A whole one without author or permlink is not; it belongs to no post."""
    problem = F.concat(F.lit("body of operation "), F.col("source_op").cast("string"), F.lit(" does not parse"))
    author = F.when(F.col("broken"), F.raise_error(problem).cast("string")).otherwise(F.col("author"))
    return parsed.withColumn("author", author).drop("broken")


def broken_bodies(ops: DataFrame) -> DataFrame:
    """Operations whose body does not parse, as they are."""
    return _parsed(ops, *ops.columns).where("broken").select(*ops.columns)


def whole_bodies(ops: DataFrame) -> DataFrame:
    """Operations whose body parses, as they are."""
    return _parsed(ops, *ops.columns).where("not broken").select(*ops.columns)


def parse_votes(ops: DataFrame) -> DataFrame:
    """Vote bodies. A weight that is not a whole number is an error."""
    return _whole(_parsed(ops, "source_op", "op_type_id")).withColumn("rshares", F.col("rshares").cast("long"))


def parse_removals(ops: DataFrame) -> DataFrame:
    """Delete and payout bodies: they concern every vote of the post, so no voter and no weight."""
    return _whole(_parsed(ops, "source_op", "op_type_id")).withColumns({
        "voter": F.lit(None).cast("string"), "rshares": F.lit(None).cast("long")})


def normalize_ops(ops: DataFrame, vote_type: int, bad_weights: bool = False) -> DataFrame:
    """Both kinds in one pass: voter and weight are read from vote bodies only. A weight that is not a whole number is
    an error, or NULL where `bad_weights` are allowed for."""
    is_vote = F.col("op_type_id") == F.lit(vote_type)
    weight = F.when(F.col("is_vote"), F.col("rshares"))
    return _whole(_parsed(ops, "source_op", is_vote.alias("is_vote"))).withColumns({
        "voter": F.when(F.col("is_vote"), F.col("voter")),
        "rshares": weight.try_cast("long") if bad_weights else weight.cast("long"),
    })
