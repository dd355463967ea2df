"""notelake: retrieval and knowledge-base analytics over notes on Spark."""
