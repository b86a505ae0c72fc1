"""textloom: text normalisation, vocabulary analytics and corpus building on Spark."""
