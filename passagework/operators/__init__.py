"""DataFrame operators: catalogue, pages, passages, vectors, figures, answers, quality."""
