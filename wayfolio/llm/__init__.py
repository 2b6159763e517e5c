"""Operations of a training-data pipeline, each as a Spark job; ``catalog`` lists their queries."""
