"""orbweaver.functions"""
