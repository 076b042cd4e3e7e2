"""Operations of a training-data pipeline over text, page and embedding tables."""
