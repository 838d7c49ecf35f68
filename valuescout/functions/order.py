"""Numbers as whole numbers in the same order."""

from pyspark.sql import Column, functions as F

from valuescout.functions.values import _col

_ONE = float(1 << 52)


def ordered_code(c) -> Column:
    """A bigint that sorts as the double does; equal doubles have equal codes.

    It is the bit pattern of the magnitude (exponent, then 52 bits of
    mantissa) with the sign of the number, so that its leading digits cut the
    doubles into finer and finer ranges. Zero has one code whatever its sign,
    NaN sorts after infinity, NULL stays NULL.
    """
    value = _col(c).cast("double")

    def exponent(size):
        # the logarithm may be off by one next to a power of two
        near = F.floor(F.log2(size))
        power = F.pow(F.lit(2.0), near)
        exact = near + (power * 2.0 <= size).cast("long") - (power > size).cast("long")
        return F.greatest(exact, F.lit(-1022).cast("long"))

    def code(size):
        scale = exponent(size)
        mantissa = (size / F.pow(F.lit(2.0), scale) * _ONE).cast("long")
        finite = (scale + 1022) * F.lit(1 << 52) + mantissa
        top = F.lit(2047 << 52)
        return (
            F.when(size.isNull(), F.lit(None).cast("long"))
            .when(F.isnan(size), top + F.lit(1 << 51))
            .when(size == float("inf"), top)
            .when(size == 0.0, F.lit(0).cast("long"))
            .otherwise(finite)
        )

    # an array of one number lets the expression refer to it by name
    magnitude = F.transform(F.array(F.abs(value)), code)[0]
    return F.when(value < 0, -magnitude).otherwise(magnitude)
