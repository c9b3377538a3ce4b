"""Operations of training-data pipelines over documents, embeddings and pages."""
