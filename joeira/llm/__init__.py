"""Operations on text and vectors for preparing training data."""
