from granary.cli import main

main()
