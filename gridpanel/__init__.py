"""gridpanel: utility-billing panels and their spatial surroundings as Spark DataFrame operators."""
