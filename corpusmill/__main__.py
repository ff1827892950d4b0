from corpusmill.cli import main

main()
