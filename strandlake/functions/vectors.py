"""Column expressions over array<double> vectors of equal length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_squared_distance(a: Column, b: Column) -> Column:
    """Squared distance of the unit vectors, twice the cosine distance."""
    return 2.0 * cosine_distance(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def saturating_manhattan(a: Column, b: Column) -> Column:
    """1 - exp(-L1)."""
    return 1.0 - F.exp(-manhattan(a, b))


# Corrected distance in hundredths for difference shares 0.750, 0.751, ... 0.930.
FAR_DISTANCES = [int(x) for x in (
    "195 196 197 198 199 200 200 201 202 203 204 205 206 207 208 209 209 210 211 212 213 214 215 216 217 218 219 220 221 222 "
    "223 224 226 227 228 229 230 231 232 233 234 236 237 238 239 240 241 243 244 245 246 248 249 250 252 253 254 255 257 258 "
    "260 261 262 264 265 267 268 270 271 273 274 276 277 279 281 282 284 285 287 289 291 292 294 296 298 299 301 303 305 307 "
    "309 311 313 315 317 319 321 323 325 328 330 332 335 337 339 342 344 347 349 352 354 357 360 362 365 368 371 374 377 380 "
    "383 386 389 393 396 399 403 407 410 414 418 422 426 430 434 438 442 447 451 456 461 466 471 476 482 487 493 498 504 511 "
    "517 524 531 538 545 553 560 569 577 586 595 605 615 626 637 649 661 675 688 703 719 736 754 775 796 819 845 874 907 945 "
    "988"
).split()]


def kimura(p: Column) -> Column:
    """Corrected distance of a difference share: the closed form below 0.75, a table of thousandths from there to 0.93, and 10 above."""
    close = -F.log(1.0 - p - p * p / 5.0)
    place = F.floor((p - 0.75) * 1000 + 0.5).cast("int")
    return F.when(p < 0.75, close).when(p > 0.93, F.lit(10.0)).otherwise(F.get(F.array(*[F.lit(x) for x in FAR_DISTANCES]), place) / 100.0)


def score_distance(score: Column, self_a: Column, self_b: Column) -> Column:
    """Distance from a score of two rows and the scores of each with itself: 2 (1 - score / the lesser), from 0 to 2; 2 where that is 0."""
    least = F.least(self_a, self_b)
    return F.when(least == 0, F.lit(2.0)).when(least < score, F.lit(0.0)).otherwise(2.0 * (1.0 - score / least))
