"""screenloom: DataFrame operators over screen-exploration data (captures, sessions, labels, frames, documents)."""
