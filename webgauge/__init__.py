"""Website audits as Spark jobs: crawl tables in, audit tables out."""
