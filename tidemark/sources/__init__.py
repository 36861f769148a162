"""OHLCV files, bars, and panels derived from other tables."""
