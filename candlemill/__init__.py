"""Price-pattern jobs over large universes of OHLCV series, written for Spark."""
