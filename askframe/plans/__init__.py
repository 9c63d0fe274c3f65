"""From a question to rows and scores: prompts, generators, execution, repair, translation, evaluation."""
